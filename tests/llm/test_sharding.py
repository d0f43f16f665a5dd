"""Sharding: the permutation is a bijection, counts are even, slots gapless, and plain Python finds the same place."""

import zlib
from collections import Counter

from assayloom.llm import sharding


def rows(spark, n, extra=False):
    data = [(i * 7 - 3, f"text {i % 11}") for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    return docs.withColumnsRenamed({}) if not extra else docs.selectExpr("*", "1 as shard", "'x' as _bucket", "2 as m", "3 as _a")


def test_shards_are_even_gapless_and_locatable(spark):
    for n in (1, 2, 5, 97, 1000):
        found = sharding.shard_documents(rows(spark, n, extra=True)).collect()
        assert sorted(r.row_number for r in found) == list(range(n))
        assert sorted(r.position for r in found) == list(range(n))
        sizes = Counter(r.shard for r in found)
        assert max(sizes.values()) - min(sizes.get(i, 0) for i in range(16)) <= 1
        for shard, count in sizes.items():
            assert sorted(r.slot for r in found if r.shard == shard) == list(range(count))
        assert all(sharding.locate(r.row_number, n) == (r.shard, r.slot) for r in found)


def test_walk_is_exact_for_every_size():
    for total in range(1, 60):
        places = [sharding.locate(i, total, 1)[1] for i in range(total)]
        assert sorted(places) == list(range(total))


def test_nulls_ties_and_empty(spark):
    data = [(None, None), (None, "a"), (3, "é"), (3, "é"), (3, ""), (4, "x" * 50000)]
    found = sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(r.position for r in found) == list(range(6))
    assert sorted((r.size, r.text_crc32) for r in found) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in data)
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STRETCH", 7)
    data = [(None, f"t{i}") for i in range(300)] + [(5, "same")] * 200 + [(None, "same")] * 100
    found = sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(r.row_number for r in found) == list(range(600)) and sorted(r.position for r in found) == list(range(600))
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in found) == sorted((d or 0, len(t) + 1, zlib.crc32(t.encode())) for d, t in data)
    assert all(sharding.locate(r.row_number, 600) == (r.shard, r.slot) for r in found)
