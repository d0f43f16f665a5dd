"""The pipeline against brute-force versions of its decisions."""

import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from assayloom.llm import tokens

SENTENCES = [f"the {a} of the {b} was with them and for the {c} that is" for a in ("house", "river", "garden") for b in ("king", "miller", "teacher") for c in ("winter", "summer", "harvest")]
ITEM = "which of the seven old lighthouses on the northern coast was painted green by the keeper before the storm arrived"


def shingle_set(text: str):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages(spark, tmp_path):
    rows = []
    for i in range(40):
        body = " ".join(f"{SENTENCES[(i * 7 + j) % len(SENTENCES)]} u{i}x{j}" for j in range(8))
        rows.append((i, body, "en" if i % 3 else None, "s", len(body)))
    rows.append((50, rows[3][1] + " tail", "en", "s", 1))
    rows.append((51, rows[3][1], "en", "s", 1))
    rows.append((52, "quite other words for this one that is with the sea " + ITEM + " and the more of it", "en", "s", 1))
    rows.append((53, "the contact of them is me.you@mail.example.com and that was with the +1 716 555 8176", "en", "s", 1))
    rows += [(54, None, "en", "s", None), (55, "123 ... 456", "en", "s", 1), (56, "", None, None, 0), (None, "the of and to with them that was for this", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    at = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs = docs.cache()
        at[name] = {r.doc_id: r for r in docs.collect()}
    assert set(at["language"]) == {r[0] for r in rows} - {54, 55, 56} and all(r.lang for r in at["language"].values())
    texts = {r[0]: r[1] for r in rows if r[0] in at["language"]}
    brute = set()
    for i in sorted(texts, key=lambda k: (k is None, k or 0)):
        a = shingle_set(texts[i])
        if not any(len(a & (b := shingle_set(texts[j]))) * 100 >= 75 * len(a | b) for j in brute):
            brute.add(i)
    assert set(at["near_duplicates"]) == brute and {50, 51}.isdisjoint(brute)
    assert set(at["near_duplicates"]) - set(at["decontaminate"]) == {i for i, t in texts.items() if ITEM in t}
    assert at["personal_data"][53].text == "the contact of them is [EMAIL] and that was with the [PHONE]" and at["personal_data"][53].n_chars == len(at["personal_data"][53].text)
    assert not any(re.search(r"@", r.text) for r in at["personal_data"].values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    plain = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    want = sorted(zlib.crc32(np.array([*plain.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in at["personal_data"].values())
    assert sorted(packed.ids_crc32) == want and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_missing_and_repeated_ids(spark, tmp_path):
    text = [" ".join(f"{SENTENCES[(i * 7 + j) % len(SENTENCES)]} u{i}x{j}" for j in range(8)) for i in range(5)]
    rows = [(1, text[0]), (1, text[0]), (None, text[0]), (None, text[0] + " tail"), (2, text[1]), (2, text[2]), (None, text[3]), (None, text[3]), (9, text[4]), (3, text[4])]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, text[0]), (2, text[1]), (2, text[2]), (0, text[3]), (3, text[4])])
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "so " + ITEM), (None, text[0]), (4, "so " + ITEM), (4, text[1]), (5, text[2])]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    clean = corpus_pipeline.decontaminate_benchmark(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted([(0, text[0]), (4, text[1]), (5, text[2])])


def test_columns_of_any_name_stay(spark, tmp_path, monkeypatch):
    text = [" ".join(f"{SENTENCES[(i * 7 + j) % len(SENTENCES)]} u{i}x{j}" for j in range(8)) for i in range(6)]
    big = 2**53 + 1
    rows = [(big + i, t, "en", 0.123, "p", "t", 7, 8) for i, t in enumerate(text)] + [(None, "so " + ITEM, None, 0.5, None, None, None, None), (big, text[0], "en", 0.123, "p", "t", 7, 8)]
    names = "doc_id long, text string, lang string, score double, lang_pred string, _text string, _row long, _lang long"
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for bound in (1_000_000, 0):  # decisions broadcast, then shuffled
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", bound)
        docs = spark.createDataFrame(rows, names)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in names.split(", ")]
        assert sorted(tuple(r) for r in docs.collect()) == sorted(rows[:6])


def test_unlabelled_and_short_texts(spark, tmp_path):
    rows = [(1, "the house", None), (2, "123", None), (3, None, None), (4, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()} == {1, 4}
