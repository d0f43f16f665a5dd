"""Packing: limits hold in every dimension, every id lies in one piece, little padding, edge cases."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from assayloom.llm import packing, tokens

PATH = tokens.vocabulary("byte_bpe_50k.json")


def test_limits_hold_and_fill_is_high():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 2049, 3000)
    loss = (size * rng.random(3000)).astype(int)
    for limits in ((2048, 256, 2048), (2048, 3, 1200)):
        loss_now = np.minimum(loss, limits[2])
        number = packing.pack(size, loss_now, limits)
        count = number.max() + 1
        assert (np.bincount(number, weights=size) <= limits[0]).all()
        assert (np.bincount(number) <= limits[1]).all()
        assert (np.bincount(number, weights=loss_now) <= limits[2]).all()
        bound = max(-(-size.sum() // limits[0]), -(-3000 // limits[1]), -(-loss_now.sum() // limits[2]))
        assert count <= 1.12 * bound
    with pytest.raises(ValueError, match="exceeds"):
        packing.pack(np.array([3000]), np.array([0]), (2048, 4, 2048))


def test_first_choice_is_the_largest_dot_product():
    # Left after the first piece: many tokens, little loss; the piece rich in tokens goes first.
    number = packing.pack(np.array([10, 60, 30]), np.array([90, 5, 5]), (100, 2, 100))
    assert number.tolist() in ([0, 0, 1], [1, 0, 0])


def test_documents(spark):
    plain = Tokenizer.from_file(PATH)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(i * 13 % 900))) for i in range(120)] + [(None, "abc"), (5, None), (5, ""), (5, ""), (7, "long word " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as sequence_id", "2 as offset", "3 as _block", "4 as length", "5 as _row", "6 as _loss")
    found = packing.pack_documents(docs, PATH, "space").toPandas()
    assert found.groupby("sequence_id").length.sum().max() <= packing.SEQUENCE
    for _, own in found.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]]
    want = []
    for doc, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    got = [(None if r.doc_id != r.doc_id else r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found.itertuples()]
    assert sorted(map(repr, [tuple(None if x is None else int(x) for x in g) for g in got])) == sorted(map(repr, want))
    assert packing.pack_documents(docs.limit(0), PATH, "space").count() == 0


def test_conversations(spark):
    turns = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", "some words here " * (c + t)) for c in range(40) for t in range(4)] + [(99, 0, None, None)], "conv_id long, turn long, role string, text string")
    pieces = packing.conversation_pieces(turns, PATH, "space").cache()
    packed = packing.pack_pieces(pieces, (2048, 16, 1024), loss="loss").toPandas()
    sums = packed.groupby("sequence_id").agg(length=("length", "sum"), loss=("loss", "sum"), n=("turn", "size"))
    assert len(packed) == 161 and sums.length.max() <= 2048 and sums.loss.max() <= 1024 and sums.n.max() <= 16


def test_one_key_of_many_rows_is_spread(spark):
    pieces = spark.range(30_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0L AS start", "100L AS length", "id AS _row", "1 AS _block")
    packed = packing.pack_pieces(pieces)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    found = packed.groupBy("sequence_id").count().toPandas()
    assert found["count"].sum() == 30_000 and found["count"].max() <= 20 and len(found) <= 1510
    assert packed.selectExpr("sequence_id >> 24 AS block").distinct().count() == 4
    assert {r.n_loss - r.length for r in packing.pack_documents(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), PATH, "space").collect()} == {-1}
