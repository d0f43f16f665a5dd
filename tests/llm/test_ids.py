"""Ids keep all their digits through every operator, beside null ids in one batch."""

import pytest

from assayloom.llm import decontaminate, language, media, neardup, packing, pii, secrets, sharding, store, tokens, toxicity

BIG = 2**53 + 1
ITEM = "which of the seven old lighthouses on the northern coast was painted green by the keeper before the storm"
ROWS = [(BIG, "the house and " + ITEM), (BIG + 1, "another text that stands here alone for the test"), (None, "so " + ITEM), (-BIG, None), (None, "")]


def run(name, docs, spark, tmp_path):
    path = f"file://{tmp_path}/store"
    if name == "store":
        store.write_store(docs, path, tokens.vocabulary("word_bpe_49k.json"), "drop")
        return store.read_digests(spark, path)
    if name == "ids":
        store.write_store(docs, path, tokens.vocabulary("word_bpe_49k.json"), "drop")
        return store.read_ids(spark, path)
    return {
        "sharding": lambda: sharding.shard_documents(docs),
        "toxicity": lambda: toxicity.score_documents(docs, toxicity.fit(["a", "b"], [0, 1])),
        "pii": lambda: pii.find_spans(docs),
        "packing": lambda: packing.pack_documents(docs, tokens.vocabulary("byte_bpe_50k.json"), "space"),
        "secrets": lambda: secrets.find_secrets(docs, secrets.fit(secrets.labelled_findings(100), epochs=1)),
        "neardup": lambda: neardup.near_duplicates(docs),
        "language": lambda: language.identify(docs, language.fit(["the house"], ["en"])),
        "media": lambda: media.text_features(docs),
    }[name]()


@pytest.mark.parametrize("name", ["sharding", "toxicity", "pii", "store", "ids", "packing", "secrets", "neardup", "language", "media"])
def test_ids(name, spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    got = run(name, docs, spark, tmp_path).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)


def test_other_ids(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(BIG + 2, ITEM), (None, ITEM)], "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == sorted((str(d), str(i)) for d in (BIG, None) for i in (BIG + 2, None))
    near = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs.where("doc_id IS NOT NULL")).collect()}
    assert near[BIG] == BIG and near[BIG + 1] == BIG + 1
    turns = spark.createDataFrame([(BIG, BIG + 2, "assistant", "some words"), (None, None, None, None)], "conv_id long, turn long, role string, text string").coalesce(1)
    pieces = packing.conversation_pieces(turns, tokens.vocabulary("byte_bpe_50k.json"), "space").collect()
    assert {(r.conv_id, r.turn, r.loss > 0) for r in pieces} == {(BIG, BIG + 2, True), (None, None, False)}
    clips = media.clips(spark.createDataFrame([(BIG, b"x"), (None, b"y"), (3, None)], "doc_id long, media binary").coalesce(1)).collect()
    assert {r.doc_id for r in clips} == {BIG, None}
