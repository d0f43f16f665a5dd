"""Operators on small tables: hand-computed values, edge cases, properties against brute force."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.functions import dna, maths, nulls, strings
from assayloom.operators import aggregate, catalog, chem, columns, design, expression, intervals, learn, plates, relational, stats, structures, windows


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- Functions --------------------------------------------------------------------------------------------------------


def test_scalar_functions(spark):
    w = spark.createDataFrame([("A1", "A1"), ("B01", "B1"), ("C003", "C3"), ("D5", "D5")], "w string, x string")
    assert w.where(strings.well_style(F.col("w")) != F.col("x")).isEmpty()
    row = spark.range(1).select(
        dna.revcomp(F.lit("AACGT")).alias("rc"), dna.gc(F.lit("ACGGT")).alias("gc"), dna.entropy(F.lit("ACGT")).alias("e2"), dna.entropy(F.lit("AAAA")).alias("e0"), strings.fraction(F.lit("12/340")).alias("fr"),
        strings.norm_path(F.lit("C:\\a\\b")).alias("np"), strings.well_name(F.lit(28), F.lit(3)).alias("w"), strings.read_id(F.lit("@r1/1 x")).alias("rid"), strings.read_mate(F.lit("r1 2:N:0")).alias("m2"), strings.read_mate(F.lit("r1.1")).alias("m1"),
        strings.mate_file(F.lit("a_R1_001.fastq.gz")).alias("mf"), strings.sentence_case(F.lit("aBC")).alias("sc"), strings.unversioned(F.lit("E1.12")).alias("uv"), strings.format_auto(F.lit(0.001), 0.01).alias("fa"), nulls.safe_log2(F.lit(0.0)).alias("l0"), nulls.ratio(F.lit(1), F.lit(0)).alias("d0"),
        maths.signif(F.lit(12345.0), 2).alias("sig"), dna.strip_stop(F.lit("MA*")).alias("ss"), dna.one_letter(F.lit("xyz")).alias("ol"),
    ).first()
    assert (row.rc, row.gc, row.e2, row.e0, row.np, row.w, row.rid, row.m2, row.m1) == ("ACGTT", 0.6, 2.0, 0.0, "/mnt/c/a/b", "AB3", "r1", 2, 1)
    assert (row.mf, row.sc, row.uv, row.fa, row.l0, row.d0, row.sig, row.ss, row.ol) == ("a_R2_001.fastq.gz", "Abc", "E1", "1.00e-03", None, None, 12000.0, "MA", "X")
    assert math.isclose(row.fr, 12 / 340) and strings.best_match(["a_x", "b_y"], ["^b", "^a"]) == "b_y" and strings.best_match([], ["a"]) == ""


def test_dna_columns(spark):
    df = spark.createDataFrame([("ATGGCCTAA", "ACGTTTACGT"), ("ATGNNN", "AAAA")], "s string, h string")
    got = df.select(dna.translate_dna("s").alias("p"), dna.hairpin("h").alias("hp"), dna.to_int("h").alias("i"), dna.from_int(dna_int(), 4).alias("b")).collect()
    assert [r.p for r in got] == ["MA*", "MX"] and got[1].hp == 0 and got[1].i == 0 and got[0].b == "GTAA"
    parts = spark.createDataFrame([("AAGAATTCTT",), ("GAATTCGAATTC",)], "d string").select(*[c.alias(f"c{i}") for i, c in enumerate(dna.split_by_enzyme(F.col("d"), "EcoRI"))]).collect()
    assert tuple(parts[0]) == ("AAG", "AATTCTT") and tuple(parts[1]) == (None, None)
    back = spark.createDataFrame([(1, "MARK")], "id int, p string").select(dna.reverse_translate("p", "id", dna.even_codons()).alias("d")).select("d", dna.translate_dna("d").alias("p")).first()
    assert back.p == "MARK" and len(back.d) == 12
    score = spark.createDataFrame([("ACGT", "ACGT"), ("ACGT", "AGT"), (None, "A")], "a string, b string").select(dna.alignment_score("a", "b").alias("s")).collect()
    assert [None if r.s is None else round(r.s, 3) for r in score] == [8.0, 5.5, None]


def dna_int():
    return "CAST(14 AS BIGINT)"


def test_tails(spark):
    """Column expressions against sums and integrals in plain Python."""
    t = spark.createDataFrame([(x, d) for x in (0.0, 0.1, -1.3, 2.5, 8.0) for d in (1.0, 2.7, 10.0, 200.5)] + [(None, 3.0), (1.0, 0.0)], "t double, df double")
    for r in t.withColumn("p", maths.t_pvalue("t", "df")).collect():
        if r.t is None or r.df == 0:
            assert r.p is None
            continue
        x = np.linspace(0, abs(r.t), 200_001)
        c = math.exp(math.lgamma((r.df + 1) / 2) - math.lgamma(r.df / 2)) / math.sqrt(r.df * math.pi)
        assert abs(r.p - (1 - 2 * np.trapezoid(c * (1 + x * x / r.df) ** (-(r.df + 1) / 2), x))) < 1e-8
    z = spark.createDataFrame([(x / 10,) for x in range(-380, 381, 19)] + [(None,)], "z double").withColumn("p", maths.normal_two_sided("z")).collect()
    assert all(r.p is None if r.z is None else abs(r.p / math.erfc(abs(r.z) / math.sqrt(2)) - 1) < 1e-9 for r in z)
    q = spark.createDataFrame([(x,) for x in (0.0, 1e-300, 1e-9, 0.001, 0.2, 0.425, 0.5, 0.7, 0.9999, 1.0)], "p double").withColumn("q", maths.probit(F.col("p"))).collect()
    assert all(r.q is None if r.p in (0, 1) else abs(r.q - NormalDist().inv_cdf(r.p)) < 1e-8 for r in q)
    h = spark.createDataFrame([(3, 20, 5, 6), (0, 50, 10, 20), (11, 50, 10, 20), (5, 2000, 300, 40)], "k int, n int, g int, d int").withColumn("p", maths.hypergeom_pvalue("k", "n", "g", "d")).collect()
    assert all(abs(r.p - sum(math.comb(r.g, i) * math.comb(r.n - r.g, r.d - i) for i in range(r.k, min(r.g, r.d) + 1)) / math.comb(r.n, r.d)) < 1e-9 for r in h)
    f = spark.createDataFrame([(3, 1, 1, 3), (0, 0, 3, 4), (100, 80, 60, 90)], "a int, b int, c int, d int").withColumn("p", maths.fisher_pvalue("a", "b", "c", "d")).collect()
    for r in f:
        n, row, col = r.a + r.b + r.c + r.d, r.a + r.b, r.a + r.c
        ways = {i: math.comb(row, i) * math.comb(n - row, col - i) for i in range(max(0, col - n + row), min(row, col) + 1)}
        assert abs(r.p - sum(w for w in ways.values() if w <= ways[r.a]) / math.comb(n, col)) < 1e-9


# --- Columns and relations --------------------------------------------------------------------------------------------


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "a", 1.0, 3.0, None), (1, None, "b", 2.0, None, None)], "Const int, Empty string, Cell_Name string, Texture_X_ch1_3_00_256 double, Texture_X_ch1_3_01_256 double, z double")
    assert columns.remove_constant(df).columns == ["Cell_Name", "Texture_X_ch1_3_00_256", "Texture_X_ch1_3_01_256"]
    assert "Empty" not in columns.remove_empty(df).columns and columns.clean_names(df).columns[2] == "cell_name"
    assert values(columns.average_directions(df), "Texture_X_ch1_3_256") == [(2.0,), (2.0,)]
    assert columns.rename_channels(df, {"ch1": "DAPI"}).columns[3] == "Texture_X_DAPI_3_00_256"
    assert columns.select_roles(df, ["^Texture"], ["01"]).columns == ["Texture_X_ch1_3_00_256"] and columns.relocate(df, "z").columns[0] == "z"
    assert values(columns.standard_chromosomes(spark.createDataFrame([("chr1",), ("MT",), ("X",), ("KI27",)], "chrom string")), "chrom") == [("chr1",), ("chrX",)]


def test_joins_treat_missing_values_alike(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(None, "p"), (2, "q")], "k int, b string")
    assert sorted(relational.natural_left_join(a, b).collect(), key=str) == sorted([(1, "x", None), (None, "y", "p")], key=str)
    assert relational.null_safe_join(a, b, ["k"], "outer").count() == 3
    assert relational.set_equal(a, a.union(a)) and not relational.set_equal(a, a.limit(1))
    with pytest.raises(ValueError, match="sum to 1"):
        relational.split_ratio(a, "k", [0.5, 0.6])


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(120)]
    df = spark.createDataFrame(pts, "id int, x double, y double, z double")
    got = {(r.id, r.id_b) for r in relational.near_pairs(df, df, 2.0).collect()}
    assert got == {(p[0], q[0]) for p in pts for q in pts if math.dist(p[1:], q[1:]) < 2.0}


# --- Aggregates, windows, statistics ----------------------------------------------------------------------------------


def test_trimmed_and_outliers(spark):
    df = spark.createDataFrame([("g", float(v), i) for i, v in enumerate([*range(1, 10), 100])] + [("one", 5.0, 0), ("none", None, 0)], "g string, x double, i int")
    assert values(aggregate.trimmed_mean(df, ["g"], ["x"], 0.1, ["i"]), "g", "x") == [("g", 5.5), ("one", 5.0)]
    assert dict(values(df.groupBy("g").agg(aggregate.trimmed_mean_agg("x", 0.1).alias("x")), "g", "x")) == {"g": 5.5, "one": 5.0, "none": None}
    out = spark.createDataFrame([(1, v) for v in [1.0, 2.0, 3.0, 4.0, 100.0]] + [(1, None)], "g int, x double")
    assert sorted(r.x for r in windows.remove_outliers(out, ["g"], ["x"]).collect() if r.x) == [1.0, 2.0, 3.0, 4.0]
    assert windows.remove_outliers(out, ["g"], ["x"]).count() == 5
    r = spark.createDataFrame([(10,), (10,), (20,)], "x int").select(windows.average_rank([F.lit(1)], F.col("x")).alias("r"))
    assert sorted(x.r for x in r.collect()) == [1.5, 1.5, 3.0]
    z = windows.inverse_normal(spark.createDataFrame([(float(i),) for i in range(3)], "x double"), "x")
    assert [round(v[1], 4) for v in values(z, "x", "int")] == [-0.9674, 0.0, 0.9674]


def test_fold_change_and_tests(spark):
    df = spark.createDataFrame([("a", "ctrl", 2.0), ("a", "ctrl", 4.0), ("a", "t", 9.0), (None, "ctrl", 1.0), (None, "t", 2.0), ("b", "t", 7.0)], "g string, c string, x double")
    fc = stats.fold_change(df, ["g"], ["x"], F.col("c") == "ctrl")
    assert {(r.g, r.x): r.x_FC for r in fc.where("c = 't'").collect()} == {("a", 9.0): 3.0, (None, 2.0): 2.0, ("b", 7.0): None}
    t = spark.createDataFrame([("c", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("d", v) for v in (2.0, 4.0, 6.0, 9.0)], "i string, x double").withColumn("g", F.lit(1))
    row = stats.welch(t, ["g"], "i", "c", "x").first()
    assert math.isclose(row.t, 1.6906412, abs_tol=1e-6) and math.isclose(row.df, 4.0836357, abs_tol=1e-6) and 0.15 < row.pvalue < 0.18
    ks = stats.ks_two_sample(t, ["g"], "x", F.col("i") == "c").first()
    assert ks.D == 0.5 and 0.5 < ks.pvalue <= 1
    bh = stats.bh_adjust(spark.createDataFrame([(0.01, 1), (0.02, 2), (0.03, 3), (None, 4)], "p double, k int"), [], "p", ["k"])
    assert [round(r.padj, 6) if r.padj else None for r in bh.orderBy("k").collect()] == [0.03, 0.03, 0.03, None]


def test_dose_response(spark):
    doses = [0.0, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0]
    rows = [("exact", d, float(stats.logistic(np.array([d]), 100, 0.5, 1.3, 10)[0])) for d in doses] + [("flat", d, 5.0) for d in doses] + [("one", 1.0, 2.0)]
    fit = {r.g: r for r in stats.fit_dose_response(spark.createDataFrame(rows, "g string, dose double, response double"), ["g"]).collect()}
    e = fit["exact"]
    assert e.converged and np.allclose([e.upper, e.ic50, e.slope, e.lower], [100, 0.5, 1.3, 10], rtol=1e-4)
    assert not fit["flat"].converged and not fit["one"].converged
    done = spark.createDataFrame([("a", 100.0, 0.5, 2.0, 0.0, 0.1, 10.0)], "g string, upper double, ic50 double, slope double, lower double, low double, high double")
    assert math.isclose(stats.inhibition_dose(done).first().ic90, 1.5) and stats.predict_curve(done, ["g"]).count() == 200
    band = stats.bootstrap_band(spark.createDataFrame(rows[:9], "g string, dose double, response double"), ["g"], repeats=5).first()
    assert band.ymin <= band.y + 1e-6
    melt = spark.createDataFrame([("w", float(x), 100 / (1 + math.exp(-(x - 50) / 2))) for x in range(25, 80)], "w string, t double, f double")
    top = stats.curve_derivative(melt, ["w"], "t", "f").orderBy(F.desc("derivative")).first()
    assert abs(top.t - 50) < 1.5


# --- Intervals --------------------------------------------------------------------------------------------------------


def random_intervals(rng, n):
    return [(i, rng.choice(["a", "b"]), s := rng.randint(1, 300), s + rng.randint(0, 40)) for i in range(n)]


def test_intervals_equal_brute_force(spark):
    rng = random.Random(7)
    rows = random_intervals(rng, 150)
    df = spark.createDataFrame(rows, "k int, chrom string, start long, end long")
    places = {(c, p) for _, c, s, e in rows for p in range(s, e + 1)}
    merged = intervals.reduce_ranges(df, ["chrom"]).collect()
    assert {(m.chrom, p) for m in merged for p in range(m.start, m.end + 1)} == places
    again = intervals.reduce_ranges(intervals.reduce_ranges(df, ["chrom"]).drop("n_merged"), ["chrom"])
    assert values(again, "chrom", "start", "end") == sorted((m.chrom, m.start, m.end) for m in merged)
    depth = {}
    for _, c, s, e in rows:
        for p in range(s, e + 1):
            depth[c, p] = depth.get((c, p), 0) + 1
    assert {(r.chrom, p): r.depth for r in intervals.coverage(df, ["chrom"]).collect() for p in range(r.start, r.end + 1)} == depth
    for width in (7, 1000):
        got = {(r.k, r.k_b) for r in intervals.overlap_join(df, df, width, 3).collect()}
        assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and min(a[3], b[3]) - max(a[2], b[2]) + 1 >= 3}
    golden = spark.createDataFrame([("c", 1, 5), ("c", 6, 9), ("c", 12, 15)], "chrom string, start long, end long")
    assert values(intervals.reduce_ranges(golden, ["chrom"]), "start", "end") == [(1, 9), (12, 15)]


def test_nearest_consensus_regions(spark):
    rng = random.Random(2)
    rows = random_intervals(rng, 60)
    pts = [(rng.choice("ab"), rng.randint(1, 340), f"g{i:02d}", rng.choice("+-")) for i in range(25)]
    got = intervals.nearest(spark.createDataFrame(rows, "k int, chrom string, start long, end long"), spark.createDataFrame(pts, "chrom string, tss long, gene string, strand string"), "k").collect()
    for r in got:
        best = min(max(r.start - p, p - r.end, 0) for c, p, _, _ in pts if c == r.chrom)
        assert abs(r.distance) == best
    peaks = spark.createDataFrame([("t", "s1", "c", 1, 10), ("t", "s2", "c", 5, 12), ("t", "s1", "c", 20, 30), ("u", "s9", "c", 3, 4)], "target string, sample string, chrom string, start long, end long")
    assert values(intervals.consensus(peaks, ["target"], "sample"), "target", "start", "end") == [("t", 5, 10), ("u", 3, 4)]
    assert intervals.consensus_beds(peaks, "target").count() == 5
    pres = intervals.presence_matrix(spark.createDataFrame([(1, "c", 1, 12), (2, "c", 40, 50)], "k int, chrom string, start long, end long"), peaks, "k", "sample", ["s1", "s2"])
    assert [(r.k, r.s1, r.s2) for r in pres.collect()] == [(1, True, True)]
    genes = spark.createDataFrame([("c", "+", 100, 200)], "chrom string, strand string, start long, end long")
    sets = intervals.gene_regions(peaks.withColumn("k", F.monotonically_increasing_id()), genes, "k", 95, 50)
    assert sets["in_gene"].isEmpty() and sets["flank_gene"].count() == 2
    m = intervals.signal_matrix(spark.createDataFrame([(1, "c", 90, 110)], "k int, chrom string, start long, end long"), spark.createDataFrame([("c", 96, 99, 2.0)], "chrom string, start long, end long, score double"), "k", 4, 8, 50)
    assert [v[1] for v in values(m, "bin", "value")] == [0.0, 2.0, 0.0, 0.0] and intervals.matrix_order(m, "k").count() == 1


def test_region_comparisons(spark):
    reads = spark.createDataFrame([("a", "c", 10, 12), ("a", "c", 11, 15), ("a", "c", 5, 6), ("b", "c", 12, 13), ("b", "c", 2, 3), ("b", "c", 31, 33)], "sample string, chrom string, start long, end long").withColumn("k", F.monotonically_increasing_id())
    regions = spark.createDataFrame([(1, "c", 10, 20)], "key int, chrom string, start long, end long")
    groups = spark.createDataFrame([("a", "t"), ("b", "n")], "sample string, group string")
    row = intervals.region_matrix(regions, reads, "key", "sample", groups, "n", ["n", "t"], 20).first()
    assert (row.n, row.t, row.t_diff) == (0.5, 2.0, 1.5)
    assert values(intervals.frip(reads, regions, "k", "sample"), "sample", "reads", "frip") == [("a", 3, 2 / 3), ("b", 3, 1 / 3)]
    assert values(intervals.fragment_lengths(reads, "sample"), "sample", "length", "n") == [("a", 2, 1), ("a", 3, 1), ("a", 5, 1), ("b", 2, 2), ("b", 3, 1)]
    sig = spark.createDataFrame([("s", "c", 5, 14, 2.0)], "sample string, chrom string, start long, end long, score double")
    assert values(intervals.bin_signal(sig, "sample", 10), "bin", "value") == [(0, 1.0), (1, 1.0)]
    d = intervals.relative_difference(spark.createDataFrame([("x", "a", 2.0), ("x", "b", 4.0), ("y", "a", 1.0), ("y", "b", 1.0)], "k string, g string, v double"), "g", ["k"], "v", "a", "b")
    assert [(r.k, r.relative_diff) for r in d.collect()] == [("x", 0.5), ("y", 1.0)]
    c = spark.createDataFrame([(2.0, 0.01, 5.0), (-2.0, 0.01, 0.5), (0.1, 0.01, 1.0)], "f double, p double, c double")
    assert [tuple(r) for r in c.select(intervals.binding_class(F.col("f"), F.col("p")), intervals.direction_class(F.col("f"), F.col("c"))).collect()] == [("Gain", "up"), ("Loss", "down_low"), ("NS", "others")]
    cat = intervals.category_totals(spark.createDataFrame([("Promoter (1kb)", 1), ("Intron 2", 2), ("Distal Intergenic", 4), ("Exon 1", 8)], "a string, n int"), "a", ["n"])
    assert values(cat, "category", "n") == [("Distal", 4), ("Gene Body", 10), ("Promoter", 1)]
    x = intervals.cross_expression(spark.createDataFrame([("g", 2.0, True), ("g", 4.0, True), ("h", 1.0, False)], "symbol string, fold double, promoter boolean"), spark.createDataFrame([("g", 1.5), ("h", 2.0)], "symbol string, log2FoldChange double"))
    assert values(x, "symbol", "fold_peak", "lfc_rna") == [("g", 3.0, 1.5)]
    prof = intervals.replicate_profile(spark.createDataFrame([("x", "r1", 1, 0, 1.0), ("x", "r2", 1, 0, 3.0)], "condition string, sample string, key int, bin int, value double"), spark.createDataFrame([("r1", 1e6), ("r2", 2e6)], "sample string, reads double"))
    assert values(prof, "value") == [(3.5,)]
    sim = expression.term_similarity(spark.createDataFrame([(t, g) for t, gs in {"a": "xyz", "b": "xyw", "c": "pqr"}.items() for g in gs], "gs_id string, gene string"))
    assert values(sim, "a", "b", "jaccard") == [("a", "b", 0.5)]
    assert values(expression.term_clusters(sim, spark.createDataFrame([("a",), ("b",), ("c",)], "gs_id string")), "gs_id", "cluster") == [("a", "a"), ("b", "a"), ("c", "c")]


# --- Sequence design --------------------------------------------------------------------------------------------------


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
    return row[-1]


def test_similarity_join_and_selection(spark):
    rng = random.Random(4)
    seqs = sorted({"".join(rng.choice("ACGT") for _ in range(8)) for _ in range(120)})
    seqs += sorted({s[:3] + s[4:] + rng.choice("ACGT") for s in seqs[:40]} - set(seqs))
    df = spark.createDataFrame([(s, i) for i, s in enumerate(seqs)], "barcode string, rank int")
    edges = {(r.a, r.b): r.distance for r in design.similar_pairs(df, 3).collect()}
    want = {(min(a, b), max(a, b)): d for i, a in enumerate(seqs) for b in seqs[:i] if (d := edit(a, b)) < 3}
    assert edges == want and design.all_pairs_below(df, 3).count() == len(want)
    kept = []
    for s in seqs:
        if all((min(s, k), max(s, k)) not in want for k in kept):
            kept.append(s)
    assert sorted(r.barcode for r in design.prune(df, 3).collect()) == sorted(kept)
    chain = spark.createDataFrame([("0", "1"), ("1", "2")], "a string, b string")
    assert values(design.select_greedy(spark.createDataFrame([("0", 0), ("1", 1), ("2", 2)], "barcode string, rank int"), chain), "barcode") == [("0",), ("2",)]


def test_design_helpers(spark):
    assert design.all_barcodes(spark, 3).select("barcode").distinct().count() == 64
    ok = design.constrain(spark.createDataFrame([("ACGTAC",), ("AAACGC",), ("ATGCGC",), ("ATATAT",)], "barcode string"))
    assert values(ok, "barcode") == [("ACGTAC",)]
    done = design.design_set(spark, 5, 3, 6)
    assert 1 <= done.count() <= 6 and design.violations(done, 3).isEmpty()
    with pytest.raises(ValueError, match="positive"):
        design.design_set(spark, 4, 9, 2)
    assert design.barcode_scores(done).columns == ["barcode", "gc", "gc_off", "entropy", "hairpin"]
    c = design.constructs(spark.createDataFrame([("CCC",)], "sequence string"), "AAAXYZTTT", "xyz", flank=2).first()
    assert (c.construct, c.primer_f, c.primer_r) == ("AAACCCTTT", "AACC", "AAGG")
    p = design.primer_plates(spark.createDataFrame([(f"p{i}",) for i in range(100)], "name string"), "name").collect()
    assert {r.plate_number for r in p} == {1, 2} and next(r.well for r in p if r.name == "p13") == "B2"
    a = spark.createDataFrame([(1, "@r1/1", "ACGT"), (2, "@r2/1", "AC")], "n int, header string, seq string")
    b = spark.createDataFrame([(1, "@r1/2", "ACGT"), (2, "@r2/2", "AC")], "n int, header string, seq string")
    assert design.validate_pairs(a, b).first().valid and not design.validate_pairs(a, b.limit(1)).first().valid
    g = design.count_guides(spark.createDataFrame([("s1", "ACGTT"), ("s1", "ACGTA")], "sample string, seq string"), spark.createDataFrame([("ACGT", "x"), ("TTTT", "y")], "guide string, symbol string"), ["s1", "s2"], 1, 4)
    assert values(g, "guide", "sample", "n") == [("ACGT", "s1", 2), ("ACGT", "s2", 0), ("TTTT", "s1", 0), ("TTTT", "s2", 0)]
    cl = design.cluster_sequences(spark.createDataFrame([("AAAA", 0), ("AAAT", 1), ("GGGG", 2)], "sequence string, rank int"), 2)
    assert values(cl, "sequence", "representative") == [("AAAA", "AAAA"), ("AAAT", "AAAA"), ("GGGG", "GGGG")]


# --- Expression -------------------------------------------------------------------------------------------------------


def test_expression(spark):
    x = spark.createDataFrame([("a", "s", 10.0, 1), ("b", "s", 20.0, 2)], "symbol string, sample string, count double, length int")
    assert values(expression.tpm(x), "tpm") == [(500000.0,), (500000.0,)]
    f = spark.createDataFrame([("CPM", 2e6, 0.0, 1.0), ("Spike", 1.0, 0.0, 1.0), ("SpikeFree", 2e6, 0.0, 2.0)], "m string, n double, s double, f double")
    assert [r[0] for r in f.select(expression.scale_factor(*map(F.col, "mnsf"))).collect()] == [0.5, 1.0, 0.25]
    assert spark.range(1).select(expression.allele_frequency(F.lit(0), F.lit(0)).alias("v")).first().v == 0
    rng = np.random.default_rng(5)
    rows = [(f"g{i}", f"s{j}", "t" if j >= 4 else "c", float(rng.poisson(200 * (8 if i < 5 and j >= 4 else 1)))) for i in range(60) for j in range(8)]
    res = expression.wald_test(spark.createDataFrame(rows, "symbol string, sample string, grp string, count double"), "grp", "c").orderBy("pvalue").collect()
    assert {r.symbol for r in res[:5]} == {f"g{i}" for i in range(5)} and all(r.log2FoldChange > 2 for r in res[:5])
    sets = spark.createDataFrame([("C", f"t{k}", f"g{i}") for k in range(4) for i in range(k * 15, k * 15 + 15)], "collection string, gs_id string, gene string")
    ora = expression.enrich_ora(spark.createDataFrame([("l", f"g{i}") for i in range(0, 25)], "list string, gene string"), sets).orderBy("pvalue").first()
    assert ora.gs_id == "t0" and ora.overlap == 15 and ora.padj < 1e-4
    ranked = spark.createDataFrame([(f"g{i}", float(30 - i)) for i in range(60)], "gene string, stat double")
    gsea = {r.gs_id: r for r in expression.enrich_gsea(ranked, sets, 200).collect()}
    plain = {r.gs_id: r.es for r in expression.running_score(ranked, sets).collect()}
    assert all(math.isclose(gsea[k].es, v, abs_tol=1e-9) for k, v in plain.items()) and gsea["t0"].es > 0.9 and gsea["t0"].pvalue < 0.05
    score = {r.gs_id: r.score for r in expression.ssgsea(ranked.withColumn("sample", F.lit("s")).withColumnRenamed("stat", "value"), sets).collect()}
    assert max(score, key=score.get) == "t0" and min(score, key=score.get) == "t3"
    v = expression.volcano(spark.createDataFrame([("a", 2.0, 1e-9), ("b", -9.0, 1e-90), ("c", 0.1, 0.5), ("d", 3.0, None)], "symbol string, log2FoldChange double, padj double"))
    assert values(v, "symbol", "direction", "range") == [("a", "up", "in"), ("b", "down", "out"), ("c", "ns", "in")]
    d = expression.poisson_distance(spark.createDataFrame([(g, s, float(c)) for s, cs in {"x": (9, 1), "y": (9, 1), "z": (1, 9)}.items() for g, c in zip("ab", cs, strict=True)], "symbol string, sample string, count double"))
    pos = {r.sample: (r.dim1, r.dim2) for r in expression.mds(d).collect()}
    assert math.dist(pos["x"], pos["y"]) < 1e-6 < math.dist(pos["x"], pos["z"])


# --- Vectors, catalogues, plates, structures --------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(1)
    pts = [(i, [float(c * 20 + rng.normal()), float(c * 20 + rng.normal())]) for i in range(90) for c in [i % 3]]
    df = spark.createDataFrame(pts, "id int, v array<double>")
    k = {r.id: r.cluster for r in chem.kmeans(df, "v", ks=range(2, 5)).collect()}
    assert len({(i % 3, c) for i, c in k.items()}) == 3
    d = {r.id: r.cluster for r in chem.dbscan(df, "id", "v", 4.0, 4).collect()}
    assert len({(i % 3, c) for i, c in d.items() if c >= 0}) == 3
    fps = [(i, [int(x) for x in rng.integers(0, 2**20, 2)]) for i in range(30)]
    tan = lambda a, b: sum(bin(x & y).count("1") for x, y in zip(a, b, strict=True)) / sum(bin(x | y).count("1") for x, y in zip(a, b, strict=True))
    picks, least = [0], {i: 2.0 for i, _ in fps}
    while len(picks) < 12:
        for i, f in fps:
            least[i] = min(least[i], 1 - tan(f, fps[picks[-1]][1]))
        picks.append(max((i for i, _ in fps if i not in picks), key=lambda i: (least[i], -i)))
    got = chem.maxmin_picks(spark.createDataFrame(fps, "compound_id int, fp array<bigint>"), 12)
    assert [r.compound_id for r in got.orderBy("rep").collect()] == picks
    x = spark.createDataFrame([(i, "u" if i % 2 else "v", float(i % 2) + rng.normal(0, 0.1), 1.0) for i in range(200)], "id int, y string, a double, b double")
    assert learn.informative(x, ["a", "b"]) == ["a"]
    assert learn.classify(x, "id", "y", ["a", "b"], 5)[1]["accuracy"] > 0.9
    _, m, imp = learn.regress(x.withColumn("t", F.col("a") * 3), "id", "t", ["a", "b"], 5)
    assert m["r2"] > 0.6 and {r.feature: r.importance > 0.1 for r in imp.collect()} == {"a": True, "b": False}
    with pytest.raises(ValueError, match="missing"):
        chem.load_library(spark.createDataFrame([(1,)], "x int"))
    assert chem.load_library(spark.createDataFrame([(1, "C")], ["ID", "Smiles"])).columns == ["compound_id", "smiles"]


def test_catalog_and_plates(spark):
    files = spark.createDataFrame([("d/p1_w1_ch1.tif",), ("d/p1_w1_ch2.tif",), ("d/p1_w1_ch1_mask.png",), ("d/junk.txt",)], "path string")
    rec = catalog.parse_files(files, "{plate}_{well}_ch{channel}.tif", "{plate}_{well}_ch{channel}_mask.png")
    g = catalog.image_groups(rec, ["plate", "well"]).first()
    assert [x.channel for x in g.intensities] == ["1", "2"] and len(g.masks) == 1 and catalog.channel_stack(catalog.image_groups(rec, ["plate"])).count() == 3
    assert catalog.find_files(rec, channel="1", type="mask").count() == 1 and [r[0] for r in catalog.unique_values(rec, "channel").collect()] == ["1", "2"]
    sheet = catalog.sample_sheet(spark.createDataFrame([("x/a_R1.fastq.gz",), ("x/a_R2.fastq.gz",), ("x/b_1.fq",)], "path string"))
    assert values(sheet, "sample", "fq2") == [("a", "x/a_R2.fastq.gz"), ("b", "NA")]
    cells = [("s", r, c, v) for r, c, v in [(3, 1, "A"), (3, 2, "1.5"), (3, 3, "x"), (4, 1, "B"), (4, 2, "2"), (20, 1, "A"), (20, 2, "9")]]
    df = spark.createDataFrame(cells, "sheet string, r int, c int, cell string")
    assert values(plates.reader_block(df, 24), "well", "value") == [("A1", 1.5), ("B1", 2.0)]
    assert values(plates.reader_block(df, 24, invert=True), "well", "value") == [("C6", 2.0), ("D6", 1.5)]
    pos = plates.stage_positions(spark, "CellVis_P24", 4, 3000.0)
    assert pos.count() == 96 and pos.where("name LIKE 'A1#%'").count() == 4 and plates.plate_types(spark).count() == 9 and pos.where("name LIKE 'A6#%'").agg({"x": "max"}).first()[0] < 93586
    with pytest.raises(ValueError, match="fit"):
        plates.field_offsets(spark, 900, 3000.0, 6000.0)


def test_structures(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(12, 3))
    a = 0.7
    rot = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    q = p @ rot + [1, 2, 3]
    rows = lambda m, t: [(t, i, 1 + i % 2, *map(float, v)) for i, v in enumerate(m)]
    s = "timestep int, id int, type int, x double, y double, z double"
    ref, moved = spark.createDataFrame(rows(p, 0), s), spark.createDataFrame(rows(q, 1), s)
    assert structures.rmsd(moved, ref).first().rmsd < 1e-9 and abs(structures.rmsd(moved, ref, align=False).first().rmsd) > 1
    back = structures.align_onto(moved, ref, ["id"]).orderBy("id").collect()
    assert np.allclose([[r.x, r.y, r.z] for r in back], p)
    frames = ref.unionByName(moved)
    n = {(r.timestep, r.id): r.n for r in structures.coordination(frames, 1.5).collect()}
    assert n[0, 0] == sum(0 < math.dist(p[0], v) < 1.5 for v in p)
    c = structures.clusters(frames, 1.0).collect()
    assert len(c) == 24 and all(r.cluster <= r.id for r in c)
    assert structures.displacement(frames).count() == 4 and structures.radial_distribution(frames, 3.0, 10, 50.0).count() > 3
    atoms = spark.createDataFrame([("A", 1, "VAL", 0.0, 0.0, 0.0), ("A", 2, "LYS", 5.0, 0.0, 0.0)], "chain string, resnum int, resname string, x double, y double, z double")
    lig = spark.createDataFrame([("L", 9, 0.0, 3.0, 0.0)], "chain string, resnum int, x double, y double, z double")
    assert values(structures.hot_spots(atoms, lig, 4.0), "resnum", "distance", "hydrophobic") == [(1, 3.0, True)]
    assert structures.hot_spots(atoms, lig, 3.0).isEmpty()


def test_similarity_join_of_mixed_lengths(spark):
    rng = random.Random(9)
    seqs = {"AAAACCCCGG", "AAAACCCCG", "", "A", "AC", "CCC"}
    for _ in range(40):
        s = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 13)))
        seqs.add(s)
        for _ in range(3):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("ACGT") + s[i:], s[:i] + rng.choice("ACGT") + s[i + 1 :]])
            seqs.add(s)
    df = spark.createDataFrame([(s,) for s in sorted(seqs)], "barcode string").repartition(2)
    for k in (1, 2, 3, 4):
        want = {(r.a, r.b, r.distance) for r in design.all_pairs_below(df, k).collect()}
        assert {(r.a, r.b, r.distance) for r in design.similar_pairs(df, k).collect()} == want
        both = {(a, b) for a, b, _ in want} | {(b, a) for a, b, _ in want} | {(s, s) for s in seqs}
        found = design.similar_pairs(df, k, other=df)
        assert {(r.a, r.b) for r in found.collect()} == both


def test_clusters_of_terms_and_signals(spark):
    """Planted groups: two dense ones that one weak link joins, and rows of three shapes."""
    genes = {g: [f"{g}{i}" for i in range(30)] for g in "ab"}
    rng = np.random.default_rng(4)
    rows = [(f"{g}t{k}", x) for g in "ab" for k in range(5) for x in rng.choice(genes[g], 24, replace=False)] + [("bridge", x) for x in genes["a"][:12] + genes["b"][:12]] + [("lonely", "z")]
    sets = spark.createDataFrame(rows, "gs_id string, gene string")
    sim = expression.term_similarity(sets, 0.2)
    brute = {k: {g for t, g in rows if t == k} for k, _ in rows}
    want = {(a, b): len(brute[a] & brute[b]) / len(brute[a] | brute[b]) for a in brute for b in brute if a < b}
    assert {(r.a, r.b): round(r.jaccard, 9) for r in sim.collect()} == {k: round(v, 9) for k, v in want.items() if v >= 0.2}
    found = {r.gs_id: r.cluster for r in expression.markov_clusters(sim, sets.select("gs_id")).collect()}
    assert len({found[f"at{k}"] for k in range(5)}) == len({found[f"bt{k}"] for k in range(5)}) == 1 and found["at0"] != found["bt0"] and found["lonely"] == "lonely"
    shape = lambda i, b: 10.0 * (i % 3) + (b if i % 3 == 1 else 0)
    m = spark.createDataFrame([(i, b, shape(i, b) + 0.01 * i) for i in range(30) for b in range(4)], "key int, bin int, value double")
    out = intervals.cluster_order(m, "key", 4).orderBy("rank").collect()
    assert [r.rank for r in out] == list(range(1, 31)) and all(r.cluster == 2 - r.key % 3 for r in out) and [r.key for r in out][:3] == [29, 26, 23]


def test_bound_columns_and_parts(spark):
    a, b = spark.createDataFrame([(3, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(9,), (8,)], "w int")
    assert [tuple(r) for r in relational.bind_columns(a, ["k"], b, ["w"]).orderBy("k").collect()] == [(1, "y", 8), (3, "x", 9)]
    with pytest.raises(Exception, match="differ in length"):
        relational.bind_columns(a, ["k"], b.limit(1), ["w"]).collect()
    with pytest.raises(ValueError, match="parts"):
        relational.split_apply(a, "k", lambda p: p, most=1)
    with pytest.raises(ValueError, match="levels"):
        learn.dummies(a, ["v"], most=1)
