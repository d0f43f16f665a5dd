"""Sequence design, compounds, learning, structures and catalogues that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions import dna, maths, tables
from assayloom.operators import catalog as K
from assayloom.operators import chem as H
from assayloom.operators import design as D
from assayloom.operators import learn
from assayloom.operators import relational as R
from assayloom.operators import structures as T
from assayloom.plans.measures import SEQ, letters
from assayloom.plans.registry import query
from assayloom.plans.tables import EMB, FILES, _files

# --- Barcodes ---------------------------------------------------------------------------------------------------------

GC = "length(regexp_replace({s}, '[^GC]', '', 'g')) / length({s})"


def rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


@query("SELECT r_regionkey, code, list_aggregate([substr('ACGT', (code // (4 ** i)::BIGINT % 4 + 1)::INTEGER, 1) FOR i IN range(0, 5)], 'string_agg', '') AS barcode FROM region, (SELECT unnest(range(0, 1024)) AS code)")
def all_barcodes(t):
    return R.expand_grid(t.region.select("r_regionkey"), D.all_barcodes(t.spark, 5))


DRAWN = "SELECT DISTINCT list_aggregate([CASE WHEN u < 0.2 THEN 'A' WHEN u < 0.5 THEN 'C' WHEN u < 0.8 THEN 'G' ELSE 'T' END FOR u IN [('0x' || substr(md5(id || ':' || i || ':3'), 1, 8))::BIGINT::DOUBLE / 4294967296.0 FOR i IN range(1, 9)]], 'string_agg', '') AS barcode FROM range(2000) AS r(id)"


@query(f"SELECT r_regionkey, barcode FROM region, ({DRAWN})")
def weighted_barcodes(t):
    """Random strings by base weights, the same in both engines."""
    return R.expand_grid(t.region.select("r_regionkey"), D.sample_barcodes(t.spark, 8, 2000, 3, {"A": 0.2, "C": 0.3, "G": 0.3, "T": 0.2}))


PASSES = f"{GC.format(s='barcode')} BETWEEN 0.35 AND 0.65 AND NOT regexp_matches(barcode, 'AAA|CCC|GGG|TTT') AND NOT regexp_matches(barcode, 'ATG|TAA|TGA|TAG')"


@query(f"SELECT r_regionkey, count(*) = 500 AND bool_and({PASSES}) AND count(DISTINCT barcode) = 500 AS fine FROM region, (SELECT barcode FROM ({DRAWN.replace('(2000)', '(4000)')}) WHERE {PASSES} LIMIT 500) GROUP BY 1")
def candidate_sampling(t):
    """So many distinct candidates that meet the constraints, topped up by further draws."""
    found = D.sample_candidates(t.spark, 8, 500, 3)
    ok = D.constrain(found).agg(F.count_distinct("barcode").alias("n"))
    return R.expand_grid(t.region.select("r_regionkey"), ok).select("r_regionkey", (F.col("n") == 500).alias("fine"))


def scan(source: str, order: str, k: int) -> str:
    """A plain scan in order that keeps what is at a distance of k or more from all kept."""
    return f"(SELECT list_reduce(list([barcode] ORDER BY {order}), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: levenshtein(x[1], y) < {k})) = 0 THEN list_concat(acc, x) ELSE acc END) AS kept FROM {source})"


BARCODES = f"bc AS (SELECT {SEQ.format(k='p_partkey', n=10)} AS barcode, min(p_partkey) AS rank FROM part GROUP BY 1)"


@query(f"WITH {BARCODES}, gr AS (SELECT unnest(kept) AS barcode FROM {scan('bc', 'rank', 4)}) SELECT barcode, rank FROM gr JOIN bc USING (barcode)")
def barcode_greedy(t):
    """What a scan in order of the part numbers keeps, without the scan."""
    return D.prune(barcodes(t), 4)


def barcodes(t, n=10):
    return t.part.groupBy(letters("p_partkey", n).alias("barcode")).agg(F.min("p_partkey").alias("rank"))


@query(f"WITH {BARCODES}, gr AS (SELECT unnest(kept) AS barcode FROM {scan('(SELECT * FROM bc WHERE rank % 4 = 0)', 'rank', 4)}), ca AS (SELECT barcode FROM bc WHERE rank % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM gr WHERE levenshtein(gr.barcode, bc.barcode) < 4)) SELECT unnest(kept) AS barcode FROM {scan('ca', 'substr(md5(barcode || chr(58) || 0), 1, 8), barcode', 4)}")
def barcode_additions(t):
    """What can be added to a selection."""
    bc = barcodes(t)
    kept = D.prune(bc.where("rank % 4 = 0"), 4)
    return D.add_compatible(bc.where("rank % 4 <> 0").select("barcode"), kept.select("barcode"), 4).select("barcode")


ALL5 = f"(SELECT list_aggregate([substr('ACGT', (code // (4 ** i)::BIGINT % 4 + 1)::INTEGER, 1) FOR i IN range(0, 5)], 'string_agg', '') AS barcode FROM (SELECT unnest(range(0, 1024)) AS code))"


@query(f"WITH ok AS (SELECT barcode FROM {ALL5} WHERE {PASSES}), gr AS (SELECT unnest(kept) AS barcode FROM {scan('ok', 'barcode', 3)}) SELECT r_regionkey, barcode FROM region, (SELECT barcode FROM gr ORDER BY barcode LIMIT 12)")
def barcode_design(t):
    """A dozen strings of five letters that differ by three edits or more."""
    return R.expand_grid(t.region.select("r_regionkey"), D.design_set(t.spark, 5, 3, 12))


PLOGP = " + ".join(f"(CASE WHEN contains(s, '{b}') THEN -(length(s) - length(replace(s, '{b}', ''))) / length(s) * log2((length(s) - length(replace(s, '{b}', ''))) / length(s)) ELSE 0 END)" for b in "ACGT")


@query(f"SELECT barcode, round(gc, 3) AS gc, round(abs(gc - 0.5), 3) AS gc_off, round(entropy, 3) AS entropy, hairpin FROM (SELECT s AS barcode, {GC.format(s='s')} AS gc, {PLOGP} AS entropy, coalesce(list_max([l FOR l IN range(1, 11) IF len([i FOR i IN range(1, 12 - l) IF contains({rc('s')}, substr(s, i, l))]) > 0]), 0)::INTEGER AS hairpin FROM (SELECT DISTINCT {SEQ.format(k='p_partkey', n=10)} AS s FROM part))", ["gc", "gc_off", "entropy"])
def barcode_scores(t):
    return D.barcode_scores(barcodes(t).select("barcode"))


@query(f"WITH {BARCODES} SELECT a.barcode AS a, b.barcode AS b, levenshtein(a.barcode, b.barcode)::INTEGER AS distance FROM bc a JOIN bc b ON a.barcode < b.barcode WHERE levenshtein(a.barcode, b.barcode) < 3 ORDER BY 3, 1, 2 LIMIT 100")
def barcode_violations(t):
    return D.violations(barcodes(t).select("barcode"), 3)


@query(f"SELECT a.s AS a, b.s AS b, levenshtein(a.s, b.s)::INTEGER AS distance FROM (SELECT {SEQ.format(k='n_nationkey', n=8)} AS s FROM nation) a JOIN (SELECT {SEQ.format(k='n_nationkey', n=8)} AS s FROM nation) b ON a.s < b.s WHERE levenshtein(a.s, b.s) < 6")
def all_pairs_below(t):
    return D.all_pairs_below(t.nation.select(letters("n_nationkey", 8).alias("barcode")), 6)


MIXED = f"mx AS (SELECT DISTINCT substr({SEQ.format(k='p_partkey', n=14)}, 1, (8 + p_partkey % 4)::INTEGER) AS s FROM part)"


@query(f"WITH {MIXED} SELECT a.s AS a, b.s AS b, levenshtein(a.s, b.s)::INTEGER AS distance FROM mx a JOIN mx b ON a.s < b.s WHERE levenshtein(a.s, b.s) < 4")
def mixed_lengths(t):
    """Pairs of strings of 8 to 11 letters nearer than four edits: more pieces than divide the lengths evenly."""
    x = t.part.select(F.expr("substring(translate(substring(md5(CAST(p_partkey AS STRING)), 1, 14), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, CAST(8 + p_partkey % 4 AS INT))").alias("barcode")).distinct()
    return D.similar_pairs(x, 4)


@query(f"""WITH s AS (SELECT {SEQ.format(k='p_partkey', n=9)} AS s, min(p_partkey) AS rank FROM part GROUP BY 1), bc AS (SELECT s AS barcode, rank FROM s), gr AS (SELECT unnest(kept) AS rep FROM {scan('bc', 'rank', 3)}), d AS (SELECT barcode, bc.rank, rep, r.rank AS rr, levenshtein(barcode, rep) AS d FROM bc JOIN gr ON levenshtein(barcode, rep) < 3 JOIN s r ON r.s = rep)
SELECT barcode AS sequence, any_value(rank) AS rank, arg_min(rep, d * 1e9 + rr) AS representative FROM d GROUP BY 1""")
def sequence_clusters(t):
    x = barcodes(t, 9).withColumnRenamed("barcode", "sequence")
    return D.cluster_sequences(x, 3)


# --- Constructs -------------------------------------------------------------------------------------------------------


@query(f"SELECT p_partkey, p_brand || '_' || replicate AS name, 'CACCG' || s AS forward, 'AAAC' || {rc('s')} || 'C' AS reverse, replicate, 'AA' || s || 'TTACGT' AS plasmid FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s, p_partkey) AS replicate FROM (SELECT p_partkey, p_brand, {SEQ.format(k='p_partkey', n=20)} AS s FROM part))")
def guide_oligos(t):
    x = t.part.select("p_partkey", F.col("p_brand").alias("symbol"), letters("p_partkey", 20).alias("guide"))
    return D.guide_oligos(x, vector="aaNNNttacgt", site="nnn").select("p_partkey", F.col("replicate").cast("long").alias("replicate"), "name", "forward", "reverse", "plasmid")


CODONS = "MAP {" + ", ".join(f"'{aa}': [{', '.join(repr(c) for c, _ in codons)}]" for aa, codons in sorted(dna.even_codons().items())) + "}"


@query(f"""WITH d AS (SELECT k AS id, string_agg({CODONS}[a][1 + least(floor((('0x' || substr(md5(k || ':' || i), 1, 8))::BIGINT::DOUBLE / 4294967296.0 - 1e-12) * len({CODONS}[a])), len({CODONS}[a]) - 1)::INTEGER], '' ORDER BY i) AS dna
FROM (SELECT k, unnest(string_split(p, '')) AS a, unnest(range(0, 6)) AS i FROM (SELECT s_suppkey AS k, translate(substr(md5(s_suppkey::VARCHAR), 1, 6), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS p FROM supplier)) GROUP BY k), n AS (SELECT *, row_number() OVER (ORDER BY id) + 10 AS number FROM d)
SELECT id, dna, {GC.format(s='dna')} AS gc, number || '_F' AS name_f, 'GG' || dna AS primer_f, number || '_R' AS name_r, 'CC' || {rc('dna')} AS primer_r FROM n""", ["gc"])
def protein_primers(t):
    p = F.translate(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 6), "0123456789abcdef", "ACDEFGHIKLMNPQRS")
    out = D.protein_primers(t.supplier.select(F.col("s_suppkey").alias("id"), p.alias("protein")), left="GG", right="CC", first=11)
    return out.select("id", "dna", "gc", "name_f", "primer_f", "name_r", "primer_r")


@query(f"SELECT p_partkey, 'AAACCC' || s || 'GGGTTTAA' AS by_marker, 'CCC' || substr(s, 1, 3) AS primer_f, 'CCC' || substr({rc('s')}, 1, 3) AS primer_r, 'TTG' || s || 'GATCCAA' AS by_enzymes FROM (SELECT p_partkey, {SEQ.format(k='p_partkey', n=12)} AS s FROM part)")
def plasmids(t):
    x = t.part.select("p_partkey", letters("p_partkey", 12).alias("sequence"))
    a = D.constructs(x, "AAACCCnnnGGGTTTAA", "NNN", flank=3).select("p_partkey", F.col("construct").alias("by_marker"), "primer_f", "primer_r")
    b = D.constructs(x, "TTGAATTCACGTGGATCCAA", ("EcoRI", "BamHI"), flank=3, cut=True).select("p_partkey", F.col("construct").alias("by_enzymes"))
    return a.join(b, "p_partkey")


@query("SELECT s_suppkey, ((k - 1) // 24 + 1)::INTEGER AS plate_number, chr((65 + (k - 1) % 24 // 6)::INTEGER) || ((k - 1) % 24 % 6 + 1) AS well FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier)")
def primer_plates(t):
    x = t.supplier.select("s_suppkey", F.concat(F.lit("p"), "s_suppkey", F.lit("_F")).alias("name"))
    return D.primer_plates(x, "name", 6, 4).select("s_suppkey", "plate_number", "well")


@query(f"WITH lib AS (SELECT p_partkey, p_brand AS symbol, {SEQ.format(k='p_partkey', n=8)} AS guide FROM part WHERE p_partkey % 2 = 0), rd AS (SELECT 's' || (l_suppkey % 3) AS sample, {SEQ.format(k='l_partkey', n=8)} AS guide FROM lineitem) SELECT p_partkey, symbol, guide, s.sample, count(rd.guide) AS n FROM lib CROSS JOIN (SELECT unnest(['s0', 's1', 's2']) AS sample) s LEFT JOIN rd USING (guide, sample) GROUP BY ALL")
def guide_counts(t):
    lib = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_brand").alias("symbol"), letters("p_partkey", 8).alias("guide"))
    reads = t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("sample"), F.concat(F.lit("TT"), letters("l_partkey", 8), F.lit("ACG")).alias("seq"))
    n = D.count_guides(reads, lib.select("guide", "symbol").distinct(), ["s0", "s1", "s2"], start=3, length=8)
    return n.join(lib, ["guide", "symbol"]).select("p_partkey", "symbol", "guide", "sample", "n")


# --- Compounds --------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey::VARCHAR AS compound_id, p_name AS smiles, p_size AS weight FROM part")
def compound_library(t):
    return H.load_library(t.part.select(F.col("p_partkey").alias(" ID "), F.col("p_name").alias("Canonical SMILES"), F.col("p_size").alias("Weight")))


@query("WITH l AS (SELECT p.p_partkey AS compound_id, o.score, o.score IS NOT NULL AS is_hit FROM part p LEFT JOIN (SELECT l_partkey, max(l_quantity) AS score FROM lineitem WHERE l_quantity = 50 AND l_tax = 0 GROUP BY 1) o ON l_partkey = p_partkey) SELECT * FROM l WHERE is_hit UNION ALL SELECT * FROM (SELECT * FROM l WHERE NOT is_hit ORDER BY substr(md5(compound_id || ':0'), 1, 8), compound_id LIMIT 40)")
def hits_and_background(t):
    hits = t.lineitem.where("l_quantity = 50 AND l_tax = 0").select(F.col("l_partkey").alias("compound_id"), F.col("l_quantity").alias("score"))
    return H.background(H.add_hits(t.part.select(F.col("p_partkey").alias("compound_id")), hits), 40)


@query("SELECT p_partkey, CASE WHEN p_size > 5 THEN 'size: ' || p_size || chr(10) ELSE '' END || 'price: ' || CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE printf('%.3f', p_retailprice) END || chr(10) || 'name: ' || p_name AS legend FROM part")
def legend_text(t):
    x = t.part.select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"))
    return x.select("p_partkey", H.legend(["size", "price", "name"], {"size": "int", "price": "double", "name": "string"}).alias("legend"))


PICKS = f"""WITH RECURSIVE {EMB}, b AS (SELECT vec_id, list_transform(v, lambda x: (x > 0)::INTEGER) AS b FROM e), r AS (SELECT 0 AS rep, 0::BIGINT AS vec_id, [0::BIGINT] AS picked
UNION ALL SELECT rep + 1, arg_max(q.vec_id, (d, -q.vec_id)), list_append(any_value(picked), arg_max(q.vec_id, (d, -q.vec_id))) FROM (SELECT r.rep, r.picked, b.vec_id, min(1 - list_sum([(b.b[i] * p.b[i]) FOR i IN range(1, 65)]) / list_sum([greatest(b.b[i], p.b[i]) FOR i IN range(1, 65)])) AS d FROM r, b, b p WHERE r.rep < 5 AND list_contains(r.picked, p.vec_id) AND NOT list_contains(r.picked, b.vec_id) GROUP BY ALL) q GROUP BY rep)
SELECT rep, vec_id FROM r"""


@query(PICKS)
def maxmin_picks(t):
    """Six vectors, each the farthest from those before it."""
    return H.maxmin_picks(t.embeddings.select("vec_id", maths.sign_bits("embedding").alias("fp")), 6, "vec_id")


# --- Learning ---------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey % 3 AS cluster, count(*) AS n FROM nation GROUP BY 1")
def kmeans_recovery(t):
    """Planted groups of points come back as clusters (numbered by their least member); k by the silhouette."""
    k = F.col("n_nationkey")
    x = t.nation.select("n_nationkey", F.array(k % 3 * 100.0 + k / 10, -(k % 3) * 50.0 - k / 20).alias("v"))
    found = H.kmeans(x, "v", ks=range(2, 6))
    first = found.groupBy("cluster").agg(F.min("n_nationkey").alias("first"), F.count(F.lit(1)).alias("n"))
    return first.select((F.col("first") % 3).alias("cluster"), "n")


@query("SELECT n_nationkey, n_nationkey % 3 AS cluster FROM nation")
def kmeans_elbow(t):
    """The same groups, k at the bend of the costs."""
    k = F.col("n_nationkey")
    x = t.nation.select("n_nationkey", F.array(k % 3 * 100.0 + k / 10, -(k % 3) * 50.0 - k / 20).alias("v"))
    found = H.kmeans_elbow(x, "v", ks=range(2, 7))
    first = found.groupBy("cluster").agg((F.min("n_nationkey") % 3).alias("label"))
    return found.join(first, "cluster").select("n_nationkey", F.col("label").alias("cluster"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN n_nationkey % 2 ELSE -1 END AS cluster FROM nation")
def density_clusters(t):
    """Two lines of points and five far from all."""
    k = F.col("n_nationkey")
    x = t.nation.select("n_nationkey", F.array(F.when(k < 20, k * 0.5).otherwise(k * 1000.0), F.when(k < 20, k % 2 * 100.0).otherwise(-k * 1000.0)).alias("v"))
    return H.dbscan(x, "n_nationkey", "v", 1.6, 3).select("n_nationkey", F.col("cluster").cast("int").alias("cluster"))


@query("WITH x AS (SELECT p_partkey, p_size::DOUBLE AS a FROM part), m AS (SELECT avg(a) AS ma FROM x) SELECT p_partkey, abs(a - ma) * sqrt(5) AS pc1, 1::DOUBLE AS share FROM x, m", ["pc1", "share"])
def pca_line(t):
    """Points on a line: their distances from the middle, and all of the variance."""
    x = t.part.select("p_partkey", F.array(F.col("p_size") * 1.0, F.col("p_size") * 2.0).alias("v"))
    mean = x.agg(F.avg(F.col("v")[0]).alias("a"), F.avg(F.col("v")[1]).alias("b"))
    centred = x.crossJoin(F.broadcast(mean)).select("p_partkey", F.array(F.col("v")[0] - F.col("a"), F.col("v")[1] - F.col("b")).alias("v"))
    out, shares = H.pca(centred, "v")
    return out.select("p_partkey", F.abs(F.col("pc")[0]).alias("pc1"), F.lit(float(shares[0])).alias("share"))


@query("SELECT k AS metric, true AS good FROM (SELECT unnest(['accuracy', 'weightedRecall', 'weightedPrecision', 'f1', 'roc_auc', 'confusion']) AS k)")
def forest_metrics(t):
    """Metrics and confusion table of a forest on classes that a column tells apart."""
    x = t.part.select("p_partkey", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("y"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    _, metrics, confusion = learn.classify(x, "p_partkey", "y", ["a", "b"], trees=10)
    wrong = confusion.where("y <> predicted").agg((F.coalesce(F.sum("n"), F.lit(0)) < 10).alias("good")).select(F.lit("confusion").alias("metric"), "good")
    return learn.metric_table(t.spark, metrics).select("metric", (F.col("value") > 0.95).alias("good")).unionByName(wrong)


@query("SELECT k AS metric, true AS good FROM (SELECT unnest(['r2', 'importance']) AS k)")
def forest_regression(t):
    """-log10 of a response that one column and one level decide; importances by shuffled columns."""
    level = F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd")
    x = t.part.select("p_partkey", F.pow(F.lit(10.0), -(F.col("p_size") / 10 + F.when(F.col("p_size") % 2 == 0, 3).otherwise(0))).alias("auc"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("noise"), level.alias("kind"))
    x, names = learn.dummies(learn.negative_log10(x, "auc"), ["kind"])
    _, metrics, importance = learn.regress(x, "p_partkey", "auc", ["a", "noise", *names], trees=20)
    first = importance.orderBy(F.desc("importance")).limit(1).select(F.lit("importance").alias("metric"), F.col("feature").isin("a", "kind_odd").alias("good"))
    return learn.metric_table(t.spark, metrics).where("metric = 'r2'").select("metric", (F.col("value") > 0.9).alias("good")).unionByName(first)


@query("SELECT 'p_size' AS kept UNION ALL SELECT 'p_retailprice'")
def informative_columns(t):
    x = t.part.withColumns({"one": F.lit(1), "rare": F.when(F.col("p_partkey") % 500 == 0, 1).otherwise(0)})
    names = learn.informative(x, ["p_size", "p_retailprice", "one", "rare"])
    return t.spark.createDataFrame([(n,) for n in names], "kept string")


# --- Structures -------------------------------------------------------------------------------------------------------

POINTS = "pt AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 100) / 10 AS x, (s_suppkey * 53 % 90) / 10 AS y, (s_suppkey * 71 % 80) / 10 AS z, s_nationkey % 2 AS half, s_nationkey % 3 + 1 AS kind FROM supplier)"
AWAY = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"


def points(t):
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("k"), (k * 37 % 100 / 10).alias("x"), (k * 53 % 90 / 10).alias("y"), (k * 71 % 80 / 10).alias("z"), (F.col("s_nationkey") % 2).alias("half"), (F.col("s_nationkey") % 3 + 1).alias("kind"))


def residues(t, half):
    name = F.element_at(F.array(F.lit("ALA"), F.lit("SER"), F.lit("TRP"), F.lit("GLU")), (F.col("k") % 4 + 1).cast("int"))
    return points(t).where(F.col("half") == half).select(F.lit("AB"[half]).alias("chain"), F.col("k").alias("resnum"), name.alias("resname"), "x", "y", "z")


@query(f"WITH {POINTS} SELECT 'A' AS chain, a.k AS resnum, ['ALA', 'SER', 'TRP', 'GLU'][a.k % 4 + 1] AS resname, min({AWAY}) AS distance, a.k % 4 IN (0, 2) AS hydrophobic FROM pt a JOIN pt b ON a.half = 0 AND b.half = 1 WHERE {AWAY} < 2 GROUP BY a.k", ["distance"])
def hot_spots(t):
    return T.hot_spots(residues(t, 0), residues(t, 1), 2.0)


@query(f"WITH {POINTS}, n AS (SELECT kind, k, row_number() OVER (PARTITION BY kind ORDER BY k) AS i, count(*) OVER (PARTITION BY kind) AS n FROM pt) SELECT 'missing' AS what, kind, k FROM pt WHERE k % 3 = 0 UNION ALL SELECT 'common', kind, k FROM pt WHERE k % 3 <> 0 UNION ALL SELECT 'middle', kind, k FROM n WHERE i = n // 2 + 2")
def residue_sets(t):
    p = points(t).select(F.concat(F.lit("c"), "kind").alias("chain"), F.col("k").alias("resnum"), F.lit("ALA").alias("resname"))
    found = p.where("resnum % 3 <> 0")
    parts = {"missing": T.missing_residues(p, found), "common": T.common_residues(p, found), "middle": T.middle_residue(p, 1).select("chain", "resnum")}
    out = [df.select(F.lit(n).alias("what"), F.substring("chain", 2, 3).cast("int").alias("kind"), F.col("resnum").alias("k")) for n, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT s_suppkey AS id, s_name AS sequence, length(s_name)::INTEGER AS length, s_acctbal AS pae FROM supplier ORDER BY s_acctbal, s_suppkey")
def design_table(t):
    return T.design_table(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("pae")), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("sequence")))


@query("SELECT s_suppkey || '#t' || s_nationkey AS id, s_suppkey::VARCHAR AS backbone, 't' || s_nationkey AS tag, '/d/' || s_suppkey || '.pdb' AS path, s_suppkey % 3 > 0 AS \"exists\" FROM supplier")
def backbone_files(t):
    ids = t.supplier.select(F.concat("s_suppkey", F.lit("#t"), "s_nationkey").alias("id"))
    files = t.supplier.where("s_suppkey % 3 > 0").select(F.concat(F.lit("/d/"), "s_suppkey", F.lit(".pdb")).alias("path"))
    return T.with_files(ids, files, folder="/d/")


#: Frames: five steps of a turn about z by 0.3 and a shift of each point by the step.
FRAMES = f"{POINTS}, fr AS (SELECT f AS timestep, k AS id, kind AS type, x * cos(0.3 * f) - y * sin(0.3 * f) + f AS x, x * sin(0.3 * f) + y * cos(0.3 * f) - 2 * f AS y, z + 3 * f AS z FROM pt, (SELECT unnest(range(0, 5)) AS f))"


def frames(t):
    f = F.col("timestep")
    turn = f * 3 / 10  # the double nearest to 0.3 f; doubles 0.3 * 3 make less than 0.9, which moves pairs over the edge of a bin
    x, y = F.col("x"), F.col("y")
    p = points(t).withColumn("timestep", F.explode(F.expr("sequence(0L, 4L)")))
    return p.select("timestep", F.col("k").alias("id"), F.col("kind").alias("type"), (x * F.cos(turn) - y * F.sin(turn) + f).alias("x"), (x * F.sin(turn) + y * F.cos(turn) - 2 * f).alias("y"), (F.col("z") + 3 * f).alias("z"))


@query(f"WITH {FRAMES} SELECT a.timestep, sqrt(avg((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS moved, 0::DOUBLE AS aligned FROM fr a JOIN fr b ON a.id = b.id AND b.timestep = 0 GROUP BY 1", ["moved", "aligned"])
def frame_rmsd(t):
    """Turned and shifted frames lie on the first one after superposition."""
    x = frames(t)
    first = x.where("timestep = 0").drop("timestep")
    plain = T.rmsd(x, first, align=False).withColumnRenamed("rmsd", "moved")
    return plain.join(T.rmsd(x, first).withColumnRenamed("rmsd", "aligned"), "timestep")


@query(f"WITH {FRAMES} SELECT id, x, y, z FROM fr WHERE timestep = 3", ["x", "y", "z"])
def superposition(t):
    """All points carried onto a turned copy by the half of them that are common."""
    x = frames(t)
    moved = T.align_onto(x.where("timestep = 0").select("id", "x", "y", "z"), x.where("timestep = 3 AND id % 2 = 0").select("id", "x", "y", "z"), ["id"])
    return moved.select("id", "x", "y", "z")


@query(f"WITH {FRAMES} SELECT a.type, a.timestep, avg((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS msd FROM fr a JOIN fr b ON a.id = b.id AND b.timestep = 0 GROUP BY 1, 2", ["msd"])
def displacement(t):
    return T.displacement(frames(t))


@query(f"WITH {FRAMES} SELECT a.type, avg((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS msd, count(*) AS pairs FROM fr a JOIN fr b ON a.id = b.id AND b.timestep = a.timestep + 2 GROUP BY 1", ["msd"])
def displacement_lag(t):
    return T.lagged_displacement(frames(t), 2)


@query(f"WITH {FRAMES}, n AS (SELECT a.timestep, a.id, count(*) AS n FROM fr a JOIN fr b ON a.timestep = b.timestep AND a.id <> b.id WHERE {AWAY} < 1.5 GROUP BY 1, 2) SELECT timestep, id, coalesce(n, 0) AS n FROM (SELECT DISTINCT timestep, id FROM fr) LEFT JOIN n USING (timestep, id)")
def coordination(t):
    return T.coordination(frames(t))


@query(f"WITH RECURSIVE {FRAMES}, e AS (SELECT a.timestep AS f, a.id AS a, b.id AS b FROM fr a JOIN fr b ON a.timestep = b.timestep WHERE a.timestep < 2 AND {AWAY} < 1.2), r AS (SELECT f, a, a AS b FROM e UNION SELECT r.f, r.a, e.b FROM r JOIN e ON r.f = e.f AND r.b = e.a) SELECT f AS timestep, a AS id, min(b) AS cluster FROM r GROUP BY 1, 2")
def atom_clusters(t):
    return T.clusters(frames(t).where("timestep < 2"), 1.2)


@query(f"WITH {FRAMES}, q AS (SELECT a.type AS a, b.type AS b, floor({AWAY} / 0.25)::INTEGER AS bin, count(*) AS pairs FROM fr a JOIN fr b ON a.timestep = b.timestep AND a.id <> b.id WHERE {AWAY} < 2 GROUP BY 1, 2, 3), n AS (SELECT type, count(*) / count(DISTINCT timestep) AS n FROM fr GROUP BY 1) SELECT a, b, bin, pairs, pairs / 5 / x.n / (y.n / 1000 * 4 / 3 * pi() * 0.25 ** 3 * ((bin + 1) ** 3 - bin ** 3)) AS g FROM q JOIN n x ON x.type = a JOIN n y ON y.type = b", ["g"])
def radial_distribution(t):
    return T.radial_distribution(frames(t), 2.0, 8, 1000.0)


@query(f"WITH {EMB}, b AS (SELECT vec_id, list_transform(v, lambda x: (x > 0)::INTEGER) AS b FROM e WHERE vec_id < 40) SELECT a.vec_id AS a, b.vec_id AS b, list_sum([(a.b[i] * b.b[i]) FOR i IN range(1, 65)]) / list_sum([greatest(a.b[i], b.b[i]) FOR i IN range(1, 65)]) AS similarity FROM b a, b b", ["similarity"])
def frame_similarity(t):
    """A matrix over the first forty vectors, as over a trajectory's frames."""
    return T.frame_similarity(t.embeddings.where("vec_id < 40").select(F.col("vec_id").alias("frame"), maths.sign_bits("embedding").alias("fp")))


# --- Catalogues -------------------------------------------------------------------------------------------------------

RECORDS = f"{FILES}, rec AS (SELECT p_partkey, path, CASE WHEN path LIKE '%_mask.png' THEN 'mask' ELSE 'intensity' END AS type, regexp_extract(path, 'd/([^_./]+)_([^_./]+)_ch([0-9]+)', 1) AS plate, regexp_extract(path, 'd/([^_./]+)_([^_./]+)_ch([0-9]+)', 2) AS well, regexp_extract(path, 'd/([^_./]+)_([^_./]+)_ch([0-9]+)', 3) AS channel FROM f WHERE path NOT LIKE '%.txt')"


def records(t):
    return K.parse_files(_files(t), "{plate}_{well}_ch{channel}.tif", "{plate}_{well}_ch{channel}_mask.png").drop("plate_n", "well_n", "channel_n")


@query(f"WITH {RECORDS} SELECT plate, well, n, grp FROM (SELECT plate, well, count(*) AS n FROM rec GROUP BY 1, 2) LEFT JOIN (SELECT 'Brand#' || (s_suppkey + 10) AS plate, s_nationkey AS grp FROM supplier) USING (plate)")
def image_metadata(t):
    groups = K.image_groups(records(t), ["plate", "well"]).select("plate", "well", (F.size("intensities") + F.size("masks")).cast("long").alias("n"))
    meta = t.supplier.select(F.concat(F.lit("Brand#"), F.col("s_suppkey") + 10).alias("plate"), F.col("s_nationkey").alias("grp"))
    return K.add_metadata(groups, meta, ["plate"])


@query(f"WITH {RECORDS} SELECT p_partkey, plate FROM rec WHERE channel IN ('0', '2') AND type = 'intensity'")
def find_files(t):
    return K.find_files(records(t), channel=["0", "2"], type="intensity").select("p_partkey", "plate")


@query(f"WITH {RECORDS} SELECT DISTINCT plate FROM rec")
def unique_plates(t):
    return K.unique_values(records(t), "plate")


@query(f"WITH {RECORDS} SELECT p_partkey, plate, well, channel, type FROM rec ORDER BY p_partkey LIMIT 1 OFFSET 7")
def file_by_index(t):
    return K.by_index(records(t), ["p_partkey"], 7).select("p_partkey", "plate", "well", "channel", "type")


@query(f"WITH {RECORDS}, n AS (SELECT type, plate, well, count(*) AS n FROM rec GROUP BY 1, 2, 3) SELECT type, count(*) AS \"groups\", avg(n) AS mean_members, min(n) AS min_members, max(n) AS max_members FROM n GROUP BY 1", ["mean_members"])
def catalog_summary(t):
    return K.catalog_summary(records(t), ["plate", "well"])


@query(f"WITH {RECORDS}, s AS (SELECT plate, well, channel, type, path, row_number() OVER (PARTITION BY plate, well ORDER BY type, channel, path) - 1 AS i FROM rec) SELECT plate, well, i::INTEGER AS \"index\", type, channel, path FROM s")
def channel_stack(t):
    return K.channel_stack(K.image_groups(records(t), ["plate", "well"]))


@query(f"WITH {RECORDS} SELECT 'plate' AS field, plate AS value, count(DISTINCT path) AS n FROM rec GROUP BY 1, 2 UNION ALL SELECT 'channel', channel, count(DISTINCT path) FROM rec GROUP BY 1, 2")
def value_index(t):
    return K.value_index(records(t), ["plate", "channel"]).select("field", "value", F.size("paths").cast("long").alias("n"))


@query("SELECT p_partkey, 'cls' || (p_size % 12) AS label, dense_rank() OVER (ORDER BY p_size % 12) - 1 AS idx FROM part WHERE p_size % 12 <> 3")
def folder_labels(t):
    files = t.part.select("p_partkey", F.concat(F.lit("img/cls"), F.col("p_size") % 12, F.lit("/"), "p_partkey", F.lit(".png")).alias("path"))
    return K.folder_labels(files, include="img/", exclude="img/cls3/").select("p_partkey", "label", F.col("idx").cast("long").alias("idx"))


@query("SELECT p_partkey, ['ctrl', 'low', NULL][p_size % 3 + 1] AS class FROM part")
def row_classes(t):
    w = F.concat(F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("p_size") % 3 + 1), F.lit("07"))
    return t.part.select("p_partkey", K.row_class(w, {"A": "ctrl", "B": "low"}).alias("class"))


@query("SELECT p_brand, p_size % 5 AS k, min('f' || p_partkey) FILTER (p_partkey % 2 = 0) AS ch0, min('f' || p_partkey) FILTER (p_partkey % 2 = 1) AS ch1 FROM part GROUP BY 1, 2")
def channels_wide(t):
    x = t.part.groupBy("p_brand", (F.col("p_size") % 5).alias("k"), F.concat(F.lit("ch"), F.col("p_partkey") % 2).alias("channel")).agg(F.min(F.concat(F.lit("f"), "p_partkey")).alias("path"))
    return K.channels_wide(x, ["p_brand", "k"], ["ch0", "ch1"])


@query("SELECT DISTINCT p_brand AS symbol FROM part WHERE p_size = 7")
def term_genes(t):
    return K.term_genes(t.part.select(F.concat(F.lit("GO:"), "p_size").alias("go_id"), F.col("p_brand").alias("symbol")), "GO:7")


# --- Table functions --------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, i::INTEGER AS pos, substr(n_name, i, 3) AS kmer FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) - 1)) AS i FROM nation)")
def kmer_rows(t):
    """A table function, laterally."""
    tables.register(t.spark)
    t.nation.createOrReplaceTempView("kmer_nations")
    return t.spark.sql("SELECT n_nationkey, k.pos, k.kmer FROM kmer_nations, LATERAL kmers(n_name, 3) AS k")


@query("SELECT r_regionkey, r::INTEGER AS row, c::INTEGER AS col, chr((64 + r)::INTEGER) || c AS well FROM region, (SELECT unnest(range(1, 9)) AS r), (SELECT unnest(range(1, 13)) AS c)")
def plate_rows(t):
    tables.register(t.spark)
    return R.expand_grid(t.region.select("r_regionkey"), t.spark.sql("SELECT * FROM plate_wells(8, 12)"))


# --- Streams ----------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS \"start\", event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2", ["total"])
def stream_windows(t):
    """The events as files that arrive: each is read once by a query that stops when there are no more, then counted."""
    from assayloom.session import scratch_path
    from assayloom.streaming import incremental

    folder, sink, state = (scratch_path(t.spark, n) for n in ("arrivals", "sink", "state"))
    for half in (0, 1):
        t.events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(folder)
        incremental.available_now(t.spark, folder, t.events.schema, sink, state).awaitTermination()
    return incremental.windowed_counts(t.spark.read.schema(t.events.schema).parquet(sink))
