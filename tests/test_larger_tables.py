"""What showed up on larger tables: ties, edges of bins, copies, long rankings."""

import itertools
import math
import os
import random
from types import SimpleNamespace

import numpy as np
import pytest

from assayloom.operators import design, expression, graph, intervals, relational, stats
from assayloom.plans import registry  # noqa: F401  (first: the other modules register with it)
from assayloom.plans import biology, layouts, relational as relational_plans, sequences


def test_frames_turn_by_exact_tenths(spark):
    """The angle of frame 3 is the double 0.9, not 0.3 * 3, which is less."""
    supplier = spark.createDataFrame([(k, k) for k in range(1, 40)], "s_suppkey long, s_nationkey int")
    got = {(r.timestep, r.id): r.x for r in layouts.frames(SimpleNamespace(supplier=supplier)).collect()}
    for k in range(1, 40):
        x, y = k * 37 % 100 / 10, k * 53 % 90 / 10
        assert got[3, k] == x * math.cos(0.9) - y * math.sin(0.9) + 3


def test_reads_across_an_empty_flank(spark):
    """Left of a region at place 1 lies the empty stretch [1, 0]; the SQL counts a read from 0 on there."""
    regions = spark.createDataFrame([(1, "c", 1, 50), (2, "c", 100, 120)], "key int, chrom string, start long, end long")
    reads = spark.createDataFrame([("c", 0, 5, "n"), ("c", 1, 5, "n"), ("c", 51, 60, "n"), ("c", 0, 5, "t")], "chrom string, start long, end long, sample string")
    got = {r.key: (r.body, r.left, r.right) for r in intervals.flank_coverage(regions, reads, "key", 20, width=10).collect()}
    assert got == {1: (3, 2, 1), 2: (0, 0, 0)}
    groups = spark.createDataFrame([("n", "n"), ("t", "t")], "sample string, group string")
    row = intervals.region_matrix(regions, reads, "key", "sample", groups, "n", ["n", "t"], 20, width=10).first()
    assert (row.key, row.n, row.t, row.t_diff) == (1, 1.0, 1.0, 0.0)
    ends = spark.createDataFrame([("c", 100, 99)], "chrom string, start long, end long")  # empty, at the edge of two bins
    over = spark.createDataFrame([("c", 90, 100), ("c", 100, 110), ("c", 90, 99)], "chrom string, start long, end long")
    assert [r.start_b for r in intervals.overlap_join(ends, over, 100, 0).collect()] == [90]
    assert intervals.overlap_join(over, over, 100, 0).count() == 7  # neighbours without a common place are no pairs


def test_merging_equal_ranges_read_in_any_order(spark, monkeypatch):
    """The first of equal ranges opens an island, whatever order they come back from the folder in."""
    write = intervals.materialize
    monkeypatch.setattr(intervals, "materialize", lambda df, name: write(df.repartition(1).sortWithinPartitions("_new"), name))
    rows = [("c", 10 * i, 10 * i + 4) for i in range(50) for _ in range(3)]
    got = intervals.reduce_ranges(spark.createDataFrame(rows, "chrom string, start long, end long"), ["chrom"]).collect()
    assert sorted((r.start, r.end, r.n_merged) for r in got) == [(10 * i, 10 * i + 4, 3) for i in range(50)]


def test_kendall_of_a_large_group(spark):
    """A group of 40,000 rows has 8e8 pairs, which the old join formed; ties, nulls and small groups as by pairs."""
    big = spark.range(40_000).selectExpr("'big' g", "id k", "id % 1000 x", "CAST(-(id % 1000) AS DOUBLE) y")
    rng = random.Random(3)
    rows = [(g, k, rng.choice([None, *range(6)]), float(rng.randrange(5))) for g in ("p", None) for k in range(37)] + [("one", 1, 1, 1.0)]
    small = spark.createDataFrame(rows, "g string, k long, x long, y double")
    got = {r.g: r.tau for r in stats.kendall(small.unionByName(big), ["g"], "k", "x", "y").collect()}
    sign = lambda v: (v > 0) - (v < 0)
    for g in ("p", None):
        v = [(x, y) for h, _, x, y in rows if h == g and x is not None]
        s = [sign((a[0] - b[0]) * (a[1] - b[1])) for a, b in itertools.combinations(v, 2)]
        assert got[g] == pytest.approx(sum(s) / len(s), abs=1e-12)
    assert set(got) == {"p", None, "big"} and got["big"] == pytest.approx(-(40 * 40 * 1000 * 999 / 2) / (40_000 * 39_999 / 2))


def test_gsea_of_a_long_ranking(spark):
    """More genes than the million that raised; a set too large to be tested is left out."""
    ranked = spark.range(1_000_500).selectExpr("concat('g', id) gene", "CAST(-id AS DOUBLE) stat")
    sets = spark.range(1, 13).selectExpr("'top' gs_id", "concat('g', id) gene").unionByName(spark.range(600).selectExpr("'wide' gs_id", "concat('g', id) gene"))
    row = expression.enrich_gsea(ranked, sets, 5).collect()
    assert [(r.gs_id, r.set_size, r.leading) for r in row] == [("top", 12, "/".join(f"g{i}" for i in range(1, 13)))]


def test_nearest_points_without_a_join_back(spark):
    """Ranges of one key each keep their own row: they carry their columns through both windows."""
    a = spark.createDataFrame([("k", "c", 1, 5), ("k", "c", 50, 60)], "key string, chrom string, start long, end long")
    points = spark.createDataFrame([("c", 7, "g", "+"), ("c", 45, "h", "-")], "chrom string, tss long, gene string, strand string")
    assert sorted((r.start, r.gene, r.distance) for r in intervals.nearest(a, points, "key").collect()) == [(1, "g", -2), (50, "h", -5)]


def test_pairs_at_just_the_radius(spark):
    """Means of discounts 0.25 apart are no pair; sums in this order make them 0.2499999999999991."""
    rows = [(1, 1.0, v / 100) for v in (0, 1, 8, 10)] + [(2, 1.0, v / 100) for v in (5, 2, 8, 3)] + [(3, 1.0, v / 100) for v in (5, 2, 8, 4)]
    rows += [(4, q, 0.5) for q in (10.0, 11.0, 30.0, 41.0)] + [(5, q, 0.5) for q in (10.0, 11.0, 30.0, 42.0)] + [(6, float("nan"), 0.5)]
    lineitem = spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_discount double").coalesce(1)
    got = sorted((r.id, r.id_b) for r in relational_plans.theta_join_grid(SimpleNamespace(lineitem=lineitem)).collect())
    assert got == [(1, 1), (1, 3), (2, 2), (3, 1), (3, 3), (4, 4), (5, 5)]


def disk_bytes(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(os.path.join(r, f)) for d in dirs for r, _, fs in os.walk(d.getPath()) for f in fs)


def test_similar_terms_write_no_candidates(spark, monkeypatch):
    """160 sets of 300 genes share genes in nearly all 12,720 pairs, whose sets the old join shuffled; few pairs are similar."""
    rng = random.Random(5)
    sets = {f"t{k}": rng.sample(range(3000), 300) for k in range(160)}
    for k in range(0, 40, 2):
        sets[f"t{k + 1}"] = sets[f"t{k}"][:200] + sets[f"t{k + 1}"][:100]
    monkeypatch.setattr(expression, "BLOCK_GENES", 10_000, raising=False)
    key, had = "spark.sql.autoBroadcastJoinThreshold", disk_bytes(spark)
    monkeypatch.setattr(expression, "MANY_FILES", 8, raising=False)
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as for tables too large to be sent
    try:
        got = {(r.a, r.b): r.jaccard for r in expression.term_similarity(spark.createDataFrame([(t, g) for t, x in sets.items() for g in x], "gs_id string, gene long"), 0.2).collect()}
    finally:
        spark.conf.set(key, before)
    assert disk_bytes(spark) - had < 5_000_000
    want = {(a, b): len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a in sets for b in sets if a < b}
    assert got == {k: v for k, v in want.items() if v >= 0.2} and len(got) >= 20


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """The least label went one or two steps a round along a chain; contraction takes rounds by the logarithm."""
    order = list(range(600))
    random.Random(6).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(399)] + [(order[i], order[i + 1]) for i in range(400, 598)] + [(-1, order[599]), (5, 5)]
    nodes = spark.createDataFrame([(k,) for k in range(600)], "id long")
    rounds, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    want = {k: min(part) for part in (order[:400], order[400:599], order[599:]) for k in part}
    for most in (3, 200_000):
        monkeypatch.setattr(graph, "MOST_EDGES", most, raising=False)
        rounds.clear()
        assert {r.id: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long"), nodes).collect()} == want
        assert len(rounds) <= 30


def test_greedy_scan_of_dense_strings(spark, monkeypatch):
    """Nearly all strings of six letters conflict with many: blocks stay small and nothing of the rest is joined. Mixed lengths too."""
    monkeypatch.setattr(design, "BLOCK", 60)
    monkeypatch.setattr(design, "AIM", 300, raising=False)
    joined, join = [], design.similar_pairs
    monkeypatch.setattr(design, "similar_pairs", lambda df, k, col="barcode", other=None: joined.append((df.count(), other)) or join(df, k, col, other))
    rng = random.Random(8)
    strings = sorted({"".join(rng.choice("ACGT") for _ in range(rng.choice((5, 6, 6, 7)))) for _ in range(900)}, key=lambda s: rng.random())

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    kept = []
    for s in strings:
        if all(distance(s, t) >= 3 for t in kept):
            kept.append(s)
    df = spark.createDataFrame([(s, i) for i, s in enumerate(strings)], "barcode string, rank int").repartition(4)
    assert [r.barcode for r in design.prune(df, 3).orderBy("rank").collect()] == kept
    assert all(other is None and n <= 480 for n, other in joined) and joined[0][0] == 60
    monkeypatch.setattr(design, "MOST_KEYS", 10, raising=False)  # many chosen strings are joined
    assert [r.barcode for r in design.prune(df, 3).orderBy("rank").collect()] == kept and any(other is not None for _, other in joined)


def test_similarity_of_just_the_bound(spark):
    """7 of 100 genes are 0.07, though 100 * 0.07 exceeds 7 in its last bits; the shared genes are the commonest."""
    rows = [("a", k) for k in range(100)] + [("b", k) for k in range(93, 100)]
    got = expression.term_similarity(spark.createDataFrame(rows, "gs_id string, gene long"), 0.07).collect()
    assert [(r.a, r.b, r.jaccard) for r in got] == [("a", "b", 0.07)]


def test_similar_strings_write_no_pairs(spark, monkeypatch):
    """4,000 strings of 8 to 11 letters have 75,000 near pairs; the old join shuffled each string's variants and all pairs.
    Blocks of the strings, and letters of which there are many, make no difference."""
    rng = random.Random(3)
    draw = lambda letters, n: sorted({"".join(rng.choice(letters) for _ in range(rng.randint(8, 11))) for _ in range(n)})
    had = disk_bytes(spark)
    df = spark.createDataFrame([(s,) for s in draw("ACGT", 4000)], "barcode string")
    pairs = design.similar_pairs(df, 4)
    assert pairs.count() > 50_000 and disk_bytes(spark) - had < 2_000_000
    monkeypatch.setattr(design, "BLOCK_LETTERS", 1500, raising=False)
    few = draw("AC", 150) + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnöpq\U0001F600", 100)
    few += [s[1:] + s[0] for s in few[150:]] + [s[:4] + s[5:] for s in few[200:]]
    df = spark.createDataFrame([(s,) for s in few], "barcode string")
    want = sorted(map(tuple, design.all_pairs_below(df, 4).collect()))
    assert sorted(map(tuple, design.similar_pairs(df, 4).collect())) == want and any(ord(a[0]) > 68 for a, _, _ in want)
