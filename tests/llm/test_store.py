"""Tokens and store: ids equal the library's, round trip, deduplication, verification and edge cases."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assayloom.llm import shingles, store, tokens

STYLES = [("word_bpe_49k.json", "drop"), ("byte_bpe_50k.json", "space")]
ODD = ["", "a", " a", "a ", "  ", "a  b", "a\n b", "a \nb", "\n\n\nx", "it's 's ' s 12 3a", "a\x00b \x00c", "a\x01 \x01b", "x\xa0y z", "é́ ́a", "<|endoftext|> x", "a<|endoftext|>b <|startoftext|>", "<|endof text|>", "q" * 70 + " " + "q" * 70 + "r", "😀 😀a", "a\tb", "foo.\nBar b", "\nx", "x\n", " \x00"]


@pytest.mark.parametrize(("name", "style"), STYLES)
def test_ids_equal_the_library(name, style):
    encode, plain = tokens.encoder(tokens.vocabulary(name), style), Tokenizer.from_file(tokens.vocabulary(name))

    def library(texts):
        return [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]

    assert [x.tolist() for x in encode.encode(ODD)] == library(ODD)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(st.sampled_from("ab.'s1 \n\tÉ\x00\x01é ")), max_size=5))
    def any_texts(texts):
        assert [x.tolist() for x in encode.encode(texts)] == library(texts)

    any_texts()
    memo = tokens.MEMO
    try:
        tokens.MEMO = 3  # forgets all the time
        assert [x.tolist() for x in encode.encode(ODD * 3)] == library(ODD * 3)
    finally:
        tokens.MEMO = memo


@pytest.mark.parametrize(("name", "style"), STYLES)
def test_pieces_with_one_hash(name, style, monkeypatch):
    encode, plain = tokens.Encoder(tokens.vocabulary(name), style), Tokenizer.from_file(tokens.vocabulary(name))
    real = tokens.piece_hashes

    def bad(data, starts, ends, *rest):
        """All pieces beyond eight bytes, and those that hash to 1, look alike."""
        out = real(data, starts, ends, *rest)
        out[(ends - starts > 8) | (out & np.uint64(7) == 0)] = 1
        out[ends - starts > 10] = 6
        return out

    monkeypatch.setattr(tokens, "piece_hashes", bad)
    for texts in ([f"word{i % 50} other{i} abcdefgh{i}ijkl" for i in range(200)], [f"w{i} x{i % 7} {i}" for i in range(300)]):
        assert [x.tolist() for x in encode.encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_hashes_of_short_pieces_are_one_to_one():
    """The mix can be undone, so eight bytes of one size never share a hash."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    y = shingles.mix(x)
    inverse = [pow(c, -1, 1 << 64) for c in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        for shift, factor in ((31, inverse[0]), (27, inverse[1]), (30, 1)):
            z = b
            for _ in range(64 // shift + 1):
                z = b ^ (z >> shift)
            b = z * factor % (1 << 64)
        assert a == b


def thue_morse(bits: int, letters: str) -> str:
    return "".join(letters[bin(i).count("1") & 1] for i in range(1 << bits))


def test_structured_words_have_their_own_ids_and_hashes():
    a, b = thue_morse(10, "ab"), thue_morse(10, "ba")
    short = [thue_morse(k, x) for k in range(3, 7) for x in ("ab", "ba")]
    for name, style in STYLES:
        encode, plain = tokens.Encoder(tokens.vocabulary(name), style), Tokenizer.from_file(tokens.vocabulary(name))
        texts = [a, b, *short, f"{a} {b}"]
        assert [x.tolist() for x in encode.encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    words = [a, b, *short]
    assert len({int(shingles.words_of(w.encode())[0]) for w in words}) == len(words)


def test_cuts_cover_and_realign():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 49000, 30_000).astype(np.uint32)
    ends = store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes[:-1].min() >= store.MIN_CHUNK and sizes.max() <= store.MAX_CHUNK
    shifted = {e - 7 for e in store.cuts(np.concatenate([ids[:7] + 1, ids]))}
    assert len(shifted & set(ends)) > 0.9 * len(ends)
    assert store.cuts(np.zeros(10_000, np.uint32))[-1] == 10_000
    assert store.crc32_join(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")


def write(spark, rows, path):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "'x' as key", "2 as part")
    store.write_store(docs, path, tokens.vocabulary("word_bpe_49k.json"), "drop")


def test_round_trip(spark, tmp_path):
    passage = " ".join(f"word{i % 97} thing{i % 31}" for i in range(3000))
    rows = [(5, passage), (2, "intro " + passage), (2, "intro " + passage), (None, "nothing"), (9, None), (8, ""), (-4, "é" * 5000)]
    path = f"file://{tmp_path}/store"
    write(spark, rows, path)
    found = store.read_digests(spark, path).orderBy("start").collect()
    plain = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    start = 0
    for row, (doc, text) in zip(found, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    whole = {r.doc_id: r.ids for r in store.read_ids(spark, path).collect()}
    assert whole[5][:-1] == plain.encode(passage, add_special_tokens=False).ids
    chunks = store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("key").distinct().count() < sum(r.n_chunks for r in found) * 0.6


def test_damage_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    write(spark, [(1, "one two three"), (2, "four")], path)
    spark.createDataFrame([(0, "00", 1, 1)], "part int, root string, n_tokens long, n_docs long").write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        store.read_digests(spark, path)


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    write(spark, [], path)
    assert store.read_digests(spark, path).count() == 0
