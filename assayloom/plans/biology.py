"""Expression, enrichment, screens, variants and regions that ``sequences`` leaves out."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.operators import expression as E
from assayloom.operators import intervals as I
from assayloom.operators import stats as S
from assayloom.plans.measures import normal_tail
from assayloom.plans.registry import query
from assayloom.plans.sequences import COUNTS, IV, MERGE, REG, RANKED, SETS, counts, intervals, regions

# --- Expression -------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, m AS method, CASE m WHEN 'CPM' THEN CASE WHEN n = 0 THEN 1 ELSE round(1e6 / n, 6) END WHEN 'Spike' THEN CASE WHEN s = 0 THEN 1 ELSE round(1e4 / s, 6) END ELSE CASE WHEN n * f = 0 THEN 1 ELSE round(1e6 / (n * f), 6) END END AS factor, CASE WHEN n = 0 THEN 0 ELSE s * 100.0::DOUBLE / n END AS pct
FROM (SELECT p_partkey, ['CPM', 'Spike', 'SpikeFree'][p_partkey % 3 + 1] AS m, (p_partkey % 7 * 1000)::DOUBLE AS n, (p_size % 5)::DOUBLE AS s, p_size / 20 AS f FROM part)""", ["factor", "pct"])
def scale_factors(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    m = F.element_at(F.array(F.lit("CPM"), F.lit("Spike"), F.lit("SpikeFree")), (k % 3 + 1).cast("int"))
    n, spike, f = (k % 7 * 1000).cast("double"), (s % 5).cast("double"), s / 20
    return t.part.select("p_partkey", m.alias("method"), E.scale_factor(m, n, spike, f).alias("factor"), E.percentage(spike, n).alias("pct"))


@query("""WITH a AS (SELECT 'g' || p_partkey AS gene_id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS symbol, CASE WHEN p_size % 5 > 0 THEN p_size END AS length FROM part),
c AS (SELECT 'g' || l_partkey AS gene_id, 's' || (l_suppkey % 8) AS sample, sum(l_quantity) / 3 AS count FROM lineitem GROUP BY 1, 2), j AS (SELECT gene_id, coalesce(symbol, gene_id) AS symbol, sample, round_even(count, 0) AS count FROM c JOIN a USING (gene_id) WHERE length IS NOT NULL)
SELECT gene_id, symbol, sample, count FROM j QUALIFY row_number() OVER (PARTITION BY symbol, sample ORDER BY gene_id) = 1""", ["count"])
def annotate_genes(t):
    """Half of the genes have two annotations, of which the least counts."""
    s = F.col("p_size")
    a = t.part.select(F.concat(F.lit("g"), "p_partkey").alias("gene_id"), F.when(s % 4 != 0, F.col("p_brand")).alias("symbol"), F.when(s % 5 > 0, s).alias("length"))
    twice = a.where("symbol IS NOT NULL AND length % 2 = 0").withColumn("symbol", F.concat("symbol", F.lit("z")))
    x = counts(t).select(F.col("symbol").alias("gene_id"), "sample", (F.col("count") / 3).alias("count"))
    return E.annotate_genes(x, a.unionByName(twice)).select("gene_id", "symbol", "sample", "count")


NB = f"""{COUNTS}, lg AS (SELECT *, ln(count) AS l FROM x), gm AS (SELECT symbol, avg(l) AS g FROM lg GROUP BY 1), sf AS (SELECT sample, exp(median(l - g)) AS size_factor FROM lg JOIN gm USING (symbol) GROUP BY 1),
xn AS (SELECT symbol, count / size_factor AS v, substr(sample, 2)::INTEGER % 2 = 0 AS ctrl FROM x JOIN sf USING (sample)),
mo AS (SELECT symbol, avg(v) AS bm, avg(v) FILTER (ctrl) AS m0, avg(v) FILTER (NOT ctrl) AS m1, count(*) FILTER (ctrl) AS n0, count(*) FILTER (NOT ctrl) AS n1, var_samp(v) FILTER (ctrl) AS v0, var_samp(v) FILTER (NOT ctrl) AS v1 FROM xn GROUP BY 1),
dd AS (SELECT *, 1 / bm AS inv, greatest(1e-4, (((n0 - 1) * coalesce(v0, 0) + (n1 - 1) * coalesce(v1, 0)) / nullif(n0 + n1 - 2, 0) - bm) / (bm * bm)) AS d FROM mo), ft AS (SELECT regr_slope(d, inv) AS a1, regr_intercept(d, inv) AS a0, avg(d) AS md FROM dd),
nb AS (SELECT *, exp((ln(d) + ln(greatest(1e-4, coalesce(a0 + a1 * inv, md)))) / 2) AS disp FROM dd, ft),
wt AS (SELECT symbol, bm AS "baseMean", log2(greatest(m1, 0.125) / greatest(m0, 0.125)) AS "log2FoldChange", sqrt((1 / greatest(m0, 0.125) + disp) / nullif(n0, 0) + (1 / greatest(m1, 0.125) + disp) / nullif(n1, 0)) / ln(2) AS "lfcSE" FROM nb)"""


def grouped(t):
    return counts(t).withColumn("grp", F.when(F.substring("sample", 2, 5).cast("int") % 2 == 0, "ctrl").otherwise("treated"))


def adjusted(source: str, key: str = "symbol") -> str:
    """SQL that adds padj to a table with pvalue."""
    return f"SELECT * EXCLUDE (bh_k, bh_m), CASE WHEN pvalue IS NOT NULL THEN least(1, min(pvalue * bh_m / bh_k) OVER (ORDER BY bh_k DESC)) END AS padj FROM (SELECT *, count(pvalue) OVER () AS bh_m, row_number() OVER (ORDER BY pvalue NULLS LAST, {key}) AS bh_k FROM {source})"


WALD = f"{NB}, st AS (SELECT *, \"log2FoldChange\" / nullif(\"lfcSE\", 0) AS stat FROM wt), pv AS (SELECT *, {normal_tail('stat')} AS pvalue FROM st), res AS ({adjusted('pv')})"
RES = ["baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue", "padj"]


@query(f"WITH {WALD} SELECT * FROM res", RES)
def wald_test(t):
    return E.wald_test(grouped(t), "grp", "ctrl")


@query(f"""WITH {NB}, ll AS (SELECT symbol, bm, n0, n1, m0, m1, disp, (n0 * m0 + n1 * m1) / (n0 + n1) AS mm FROM nb WHERE n0 > 0 AND n1 > 0),
lr AS (SELECT symbol, bm AS "baseMean", greatest(0, 2 * (n0 * (m0 * ln(m0) - (m0 + 1 / disp) * ln(1 + disp * m0)) + n1 * (m1 * ln(m1) - (m1 + 1 / disp) * ln(1 + disp * m1)) - n0 * (m0 * ln(mm) - (m0 + 1 / disp) * ln(1 + disp * mm)) - n1 * (m1 * ln(mm) - (m1 + 1 / disp) * ln(1 + disp * mm)))) AS lr FROM ll),
z AS (SELECT *, sqrt(lr) AS z FROM lr), pv AS (SELECT symbol, "baseMean", lr, {normal_tail('z')} AS pvalue FROM z) {adjusted('pv')}""", ["baseMean", "lr", "pvalue", "padj"])
def likelihood_ratio(t):
    return E.likelihood_ratio(grouped(t), "grp", "ctrl")


SHRUNK = f"""{WALD}, pr AS (SELECT greatest(avg("log2FoldChange" * "log2FoldChange" - "lfcSE" * "lfcSE"), 1e-6) AS p FROM res), sh AS (SELECT symbol, stat, pvalue, padj, "log2FoldChange" * p / (p + "lfcSE" * "lfcSE") AS lfc, sqrt(p / (p + "lfcSE" * "lfcSE")) * "lfcSE" AS se FROM res, pr),
zz AS (SELECT *, lfc / nullif(se, 0) AS z FROM sh), fs AS (SELECT symbol, stat, pvalue, padj, lfc, se, ({normal_tail('z')}) / 2 AS lfsr FROM zz)"""


@query(f"WITH {SHRUNK} SELECT symbol, lfc AS \"log2FoldChange\", se AS \"lfcSE\", lfsr, avg(lfsr) OVER (ORDER BY lfsr NULLS LAST, symbol ROWS UNBOUNDED PRECEDING) AS svalue, stat, pvalue, padj FROM fs", ["log2FoldChange", "lfcSE", "lfsr", "svalue", "stat", "pvalue", "padj"])
def shrunk_results(t):
    from assayloom.session import materialize

    plain = materialize(E.wald_test(grouped(t), "grp", "ctrl"), "wald")
    return E.result_table(E.shrink(plain.select("symbol", "log2FoldChange", "lfcSE")), plain)


#: A result table of simple numbers: fold changes between -6 and 6, adjusted p between 0 and 1, some missing.
RESULT = "rs AS (SELECT 'g' || p_partkey AS symbol, (p_partkey * 37 % 121 - 60) / 10 AS \"log2FoldChange\", CASE WHEN p_size % 10 <> 0 THEN (p_partkey * 17 % 1000 + 1) / 20000.0::DOUBLE END AS padj FROM part)"


def result(t):
    k = F.col("p_partkey")
    return t.part.select(F.concat(F.lit("g"), k).alias("symbol"), ((k * 37 % 121 - 60) / 10).alias("log2FoldChange"), F.when(F.col("p_size") % 10 != 0, (k * 17 % 1000 + 1) / 20000.0).alias("padj"))


@query(f"WITH {RESULT} SELECT symbol FROM rs WHERE abs(\"log2FoldChange\") >= log2(1.5::DOUBLE) AND padj < 0.01 AND substr(symbol, 2)::INTEGER % 3 = 0")
def deg_genes(t):
    return E.deg(result(t), among=t.part.where("p_partkey % 3 = 0").select(F.concat(F.lit("g"), "p_partkey").alias("symbol")))


HASHED = "('0x' || substr(md5({k} || ':0'), 1, 8))::BIGINT"


@query(f"""WITH {RESULT}, c AS (SELECT *, CASE WHEN padj < 0.01 AND "log2FoldChange" >= log2(1.5::DOUBLE) THEN 'up' WHEN padj < 0.01 AND "log2FoldChange" <= -log2(1.5::DOUBLE) THEN 'down' ELSE 'ns' END AS direction, -log10(padj) AS y0 FROM rs WHERE padj IS NOT NULL),
v AS (SELECT symbol, "log2FoldChange", padj, direction, least(greatest("log2FoldChange", -5), 5) AS x, least(greatest(y0, 0), 2) AS y, CASE WHEN abs("log2FoldChange") > 5 OR y0 > 2 THEN 'out' ELSE 'in' END AS range FROM c)
SELECT * FROM v WHERE direction <> 'ns' UNION ALL SELECT * FROM (SELECT * FROM v WHERE direction = 'ns' ORDER BY {HASHED.format(k='symbol')}, symbol LIMIT 50)""", ["log2FoldChange", "padj", "x", "y"])
def volcano_table(t):
    return E.volcano(result(t), y_max=2, background=50)


@query(f"WITH {COUNTS}, g AS (SELECT symbol, sample, avg(count) AS m FROM x GROUP BY 1, 2) SELECT symbol, CASE WHEN d1 IS NOT NULL THEN least(greatest(d1, -50), 50) END AS s1, CASE WHEN d2 IS NOT NULL THEN least(greatest(d2, -50), 50) END AS s2 FROM (SELECT symbol, max(m) FILTER (sample = 's1') - max(m) FILTER (sample = 's0') AS d1, max(m) FILTER (sample = 's2') - max(m) FILTER (sample = 's0') AS d2 FROM g GROUP BY 1)", ["s1", "s2"])
def group_difference(t):
    return E.group_difference(counts(t), "symbol", "sample", "s0", "count", ["s1", "s2"], 50.0)


# --- Enrichment -------------------------------------------------------------------------------------------------------


def log_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


ORA = f"""{SETS}, sz AS (SELECT collection, gs_id, count(*) AS set_size FROM sets GROUP BY 1, 2 HAVING count(*) BETWEEN 10 AND 500), kn AS (SELECT list, collection, gene FROM lists JOIN (SELECT DISTINCT collection, gene FROM sets) USING (gene)), dr AS (SELECT list, collection, count(*) AS list_size FROM kn GROUP BY 1, 2 HAVING count(*) >= 20),
tot AS (SELECT collection, count(DISTINCT gene) AS total FROM sets GROUP BY 1), h AS (SELECT list, collection, gs_id, count(*) AS overlap FROM kn JOIN sets USING (collection, gene) GROUP BY 1, 2, 3), j AS (SELECT collection, list, gs_id, overlap, set_size, list_size, total FROM h JOIN sz USING (collection, gs_id) JOIN dr USING (list, collection) JOIN tot USING (collection)),
p AS (SELECT *, least(1, list_sum([exp({log_choose('set_size', 'i')} + {log_choose('(total - set_size)', '(list_size - i)')} - {log_choose('total', 'list_size')}) FOR i IN range(greatest(overlap, list_size - (total - set_size), 0), least(set_size, list_size) + 1)])) AS pvalue FROM j)"""


@query(f"WITH {ORA} SELECT * EXCLUDE (k, m), least(1, min(pvalue * m / k) OVER (PARTITION BY list, collection ORDER BY k DESC)) AS padj FROM (SELECT *, count(*) OVER (PARTITION BY list, collection) AS m, row_number() OVER (PARTITION BY list, collection ORDER BY pvalue, gs_id) AS k FROM p)", ["pvalue", "padj"])
def ora_pvalues(t):
    sets = t.part.select(F.lit("C").alias("collection"), F.col("p_brand").alias("gs_id"), F.concat(F.lit("g"), "p_partkey").alias("gene"))
    lists = t.orders.where("o_totalprice > 300000").select(F.concat(F.lit("l"), F.col("o_custkey") % 5).alias("list"), F.concat(F.lit("g"), F.col("o_custkey") % 2000).alias("gene"))
    return E.enrich_ora(lists, sets)


@query(f"""WITH {RANKED}, s AS (SELECT DISTINCT p_brand AS gs_id, 'g' || p_partkey AS gene FROM part), j AS (SELECT gs_id, gene, k, n, count(*) OVER (PARTITION BY gs_id) AS z, abs(stat) / sum(abs(stat)) OVER (PARTITION BY gs_id) AS w FROM s JOIN rk USING (gene)),
r AS (SELECT *, sum(w) OVER (PARTITION BY gs_id ORDER BY k) AS h, row_number() OVER (PARTITION BY gs_id ORDER BY k) AS i FROM j WHERE z BETWEEN 10 AND 500), d AS (SELECT gs_id, gene, k, z, h - (k - i) / (n - z) AS up, h - (k - i) / (n - z) - w AS down FROM r),
e AS (SELECT gs_id, min(z) AS set_size, CASE WHEN max(up) >= -min(down) THEN max(up) ELSE min(down) END AS es, CASE WHEN max(up) >= -min(down) THEN arg_max(k, up) END AS hi, CASE WHEN max(up) < -min(down) THEN arg_min(k, down) END AS lo FROM d GROUP BY 1)
SELECT gs_id, set_size::INTEGER AS set_size, es, string_agg(gene, '/' ORDER BY k) FILTER (k <= hi OR k >= lo) AS leading, true AS fine FROM d JOIN e USING (gs_id) GROUP BY gs_id, set_size, es""", ["es"])
def gsea_test(t):
    """Scores and leading genes; normalised scores have the sign of the score, and p lies between 0 and 1 and below its adjusted one."""
    ranked = t.part.select(F.concat(F.lit("g"), "p_partkey").alias("gene"), F.sin("p_partkey").alias("stat"))
    x = E.enrich_gsea(ranked, t.part.select(F.col("p_brand").alias("gs_id"), F.concat(F.lit("g"), "p_partkey").alias("gene")), 200)
    fine = (F.signum("nes") == F.signum("es")) & (F.col("pvalue") > 0) & (F.col("pvalue") <= F.col("padj")) & (F.col("padj") <= 1)
    return x.select("gs_id", "set_size", "es", "leading", fine.alias("fine"))


@query("""WITH x AS (SELECT p_brand AS facet, p_name || p_partkey AS gs_id, p_size - 25 AS "NES", (p_size % 13) || '/' || p_size AS "GeneRatio", p_name || '/b/c' AS core FROM part WHERE p_size <> 25),
k AS (SELECT *, row_number() OVER (PARTITION BY facet, sign("NES") ORDER BY abs("NES") DESC, gs_id) AS k FROM x) SELECT facet, gs_id, "NES", "GeneRatio", (split_part("GeneRatio", '/', 1)::DOUBLE / split_part("GeneRatio", '/', 2)::DOUBLE) AS ratio, len(string_split(core, '/'))::INTEGER AS n_core FROM k WHERE k <= 3""", ["ratio"])
def top_terms(t):
    s = F.col("p_size")
    x = t.part.where("p_size <> 25").select(F.col("p_brand").alias("facet"), F.concat("p_name", "p_partkey").alias("gs_id"), (s - 25).alias("NES"), F.concat_ws("/", s % 13, s).alias("GeneRatio"), F.concat("p_name", F.lit("/b/c")).alias("core"))
    return E.top_terms(x, ["facet"], "NES", 3, direction=True).withColumn("n_core", E.core_genes(F.col("core"))).drop("core")


#: Similar terms: each order's parts, and copies of some with a part left out; similarity links a copy to its original.
TERMS = "tm AS (SELECT DISTINCT 'o' || l_orderkey AS gs_id, l_partkey AS gene FROM lineitem UNION SELECT DISTINCT 'z' || l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber > 1)"


def terms(t):
    g = t.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("gs_id"), F.col("l_partkey").alias("gene"))
    z = t.lineitem.where("l_orderkey % 5 = 0 AND l_linenumber > 1").select(F.concat(F.lit("z"), "l_orderkey").alias("gs_id"), F.col("l_partkey").alias("gene"))
    return g.unionByName(z).distinct()


CLUSTERS = f"""WITH RECURSIVE {TERMS}, n AS (SELECT gs_id, count(*) AS n FROM tm GROUP BY 1), c AS (SELECT a.gs_id AS a, b.gs_id AS b, count(*) AS c FROM tm a JOIN tm b ON a.gene = b.gene AND a.gs_id < b.gs_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.gs_id = a JOIN n y ON y.gs_id = b WHERE c / (x.n + y.n - c) >= 0.5), w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT gs_id AS a, gs_id AS b FROM n UNION SELECT r.a, w.b FROM r JOIN w ON r.b = w.a) SELECT a AS gs_id, min(b) AS cluster FROM r GROUP BY 1"""


@query(CLUSTERS)
def term_clusters(t):
    x = terms(t)
    return E.term_clusters(E.term_similarity(x, 0.5), x.select("gs_id").distinct())


@query("SELECT 't' || n_nationkey AS gs_id, 't' || min(n_nationkey::VARCHAR) OVER (PARTITION BY n_regionkey) AS cluster FROM nation")
def term_markov(t):
    """Terms of a region share most genes; one gene that all terms have links the regions weakly."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    own = t.nation.select(F.concat(F.lit("t"), k).alias("gs_id"), F.explode(F.sequence(r * 100, r * 100 + 8)).alias("gene"))
    extra = t.nation.select(F.concat(F.lit("t"), k).alias("gs_id"), F.explode(F.array(F.lit(-1), k * 1000 + 7)).alias("gene"))
    x = own.unionByName(extra)
    return E.markov_clusters(E.term_similarity(x, 0.03), x.select("gs_id"))


EXPR = f"{COUNTS}, gs AS (SELECT DISTINCT p_brand AS gs_id, 'g' || p_partkey AS symbol FROM part)"


def expression(t):
    sets = t.part.select(F.col("p_brand").alias("gs_id"), F.concat(F.lit("g"), "p_partkey").alias("gene"))
    return counts(t).select(F.col("symbol").alias("gene"), "sample", F.col("count").alias("value")), sets


@query(f"""WITH {EXPR}, r AS (SELECT symbol, sample, row_number() OVER (PARTITION BY sample ORDER BY count DESC, symbol) AS k, count(*) OVER (PARTITION BY sample) AS n FROM x),
s AS (SELECT gs_id, sample, r.*, (n - k + 1) AS left_, power(n - k + 1, 0.25) AS w FROM r JOIN gs USING (symbol)), a AS (SELECT gs_id, sample, sum(w * left_) / sum(w) AS hit, sum(left_) AS sl, count(*) AS m, max(n) AS n FROM s GROUP BY 1, 2)
SELECT gs_id, sample, hit - (n * (n + 1) / 2 - sl) / (n - m) AS score FROM a""", ["score"])
def ssgsea(t):
    return E.ssgsea(*expression(t))


@query(f"""WITH {EXPR}, z AS (SELECT symbol, sample, cume_dist() OVER (PARTITION BY symbol ORDER BY count) AS z FROM x), r AS (SELECT symbol, sample, row_number() OVER (PARTITION BY sample ORDER BY z DESC, symbol) AS k, count(*) OVER (PARTITION BY sample) AS n FROM z),
j AS (SELECT gs_id, sample, k, n, abs(n / 2 - (n - k + 1)) AS w FROM r JOIN gs USING (symbol)), q AS (SELECT *, count(*) OVER (PARTITION BY gs_id, sample) AS m, sum(w) OVER (PARTITION BY gs_id, sample ORDER BY k) / sum(w) OVER (PARTITION BY gs_id, sample) AS h, w / sum(w) OVER (PARTITION BY gs_id, sample) AS s, row_number() OVER (PARTITION BY gs_id, sample ORDER BY k) AS i FROM j)
SELECT gs_id, sample, greatest(max(h - (k - i) / (n - m)), 0) + least(min(h - (k - i) / (n - m) - s), 0) AS score FROM q GROUP BY 1, 2""", ["score"])
def gsva(t):
    return E.gsva(*expression(t))


@query(f"WITH {RESULT} SELECT symbol, CASE WHEN w * \"log2FoldChange\" > 0 THEN 'concordant' WHEN w * \"log2FoldChange\" < 0 THEN 'discordant' END AS quadrant FROM (SELECT *, substr(symbol, 2)::INTEGER % 3 - 1 AS w FROM rs)")
def activity_quadrant(t):
    w = F.substring("symbol", 2, 20).cast("int") % 3 - 1
    return result(t).select("symbol", E.quadrant(w, F.col("log2FoldChange")).alias("quadrant"))


# --- Screens ----------------------------------------------------------------------------------------------------------


@query("SELECT 'sg' || p_partkey AS sgrna, p_brand AS symbol, p_size AS control_count, p_size + 1 AS treatment_count, p_size::DOUBLE AS control_mean, p_size + 0.5::DOUBLE AS treat_mean, p_retailprice AS score, p_size / 51 AS pvalue, p_size - 25.0::DOUBLE AS lfc, p_size % 2 = 0 AS high_in_treatment FROM part", ["pvalue"])
def guide_summary(t):
    s = F.col("p_size")
    x = t.part.select(F.concat(F.lit("sg"), "p_partkey").alias("sgrna"), F.col("p_brand").alias("Gene"), s.alias("control_count"), (s + 1).alias("treatment_count"), s.cast("double").alias("control_mean"), (s + 0.5).alias("treat_mean"), F.col("p_retailprice").alias("score"), (s / 51).alias("p.twosided"), (s - 25.0).alias("LFC"), (s % 2 == 0).alias("high_in_treatment"), F.lit(1).alias("other"))
    return E.read_rra_sgrna(x)


@query("SELECT l_partkey AS gene, avg(l_discount) AS dependency, p_size % 2 = 0 AS essential FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY 1, p_size", ["dependency"])
def gene_dependency(t):
    e = t.part.where("p_size > 10").select(F.col("p_partkey").alias("gene"), (F.col("p_size") % 2 == 0).alias("essential"))
    return E.dependency(t.lineitem.select(F.col("l_partkey").alias("gene"), F.col("l_discount").alias("dependency")), e)


SCREEN = "SELECT p_partkey AS symbol, (p_partkey * {m} % 100) / 500 AS pvalue, (p_partkey * {m} % 41 - 20) / 10 AS lfc FROM part"


def screen(t, m):
    k = F.col("p_partkey")
    return t.part.select(k.alias("symbol"), (k * m % 100 / 500).alias("pvalue"), ((k * m % 41 - 20) / 10).alias("lfc"))


@query(f"WITH a AS ({SCREEN.format(m=7)}), b AS ({SCREEN.format(m=11)}) SELECT symbol, a.lfc AS a_lfc, a.pvalue AS a_pvalue, b.lfc AS b_lfc, b.pvalue AS b_pvalue FROM a JOIN b USING (symbol) WHERE a.pvalue < 0.05 AND abs(a.lfc) > 0.58", ["a_lfc", "a_pvalue", "b_lfc", "b_pvalue"])
def retained_genes(t):
    return E.retained({"a": screen(t, 7), "b": screen(t, 11)}, "a", ["lfc", "pvalue"])


@query(f"SELECT symbol FROM ({SCREEN.format(m=7)}) WHERE pvalue < 0.05 AND symbol % 6 >= 3 AND symbol % 2 = 0")
def coding_hits(t):
    k = F.col("symbol")
    return E.coding_hits(screen(t, 7).withColumns({"goodsgrna": k % 6, "locus_type": F.when(k % 2 == 0, "protein-coding").otherwise("pseudo")})).select("symbol")


@query(f"SELECT a.symbol, a.lfc AS sh_a_beta, a.pvalue AS sh_a_pvalue, b.lfc AS b_beta, b.pvalue AS b_pvalue, a.symbol % 9 AS \"sgRNA\" FROM ({SCREEN.format(m=7)}) a JOIN ({SCREEN.format(m=11)}) b USING (symbol) WHERE (a.pvalue < 0.05 OR b.pvalue < 0.05) AND a.symbol % 9 >= 5", ["sh_a_beta", "sh_a_pvalue", "b_beta", "b_pvalue"])
def beta_table(t):
    a = screen(t, 7).withColumnsRenamed({"lfc": "sh-a|beta", "pvalue": "sh-a|pvalue"})
    b = screen(t, 11).withColumnsRenamed({"lfc": "b|beta", "pvalue": "b|pvalue"})
    return E.beta_table(a.join(b, "symbol").withColumn("sgRNA", F.col("symbol") % 9), ["sh_a", "b"])


@query(f"""WITH {COUNTS}, s AS (SELECT sample, sum(count) AS t FROM x GROUP BY 1), g AS (SELECT DISTINCT symbol FROM x), f AS (SELECT g.symbol, s.sample, s.t, coalesce(count, 0) AS c FROM g CROSS JOIN s LEFT JOIN x ON x.symbol = g.symbol AND x.sample = s.sample),
p AS (SELECT a.sample AS a, b.sample AS b, a.c AS xa, b.c AS xb, a.t * (a.c + b.c) / (a.t + b.t) AS na, b.t * (a.c + b.c) / (a.t + b.t) AS nb FROM f a JOIN f b USING (symbol))
SELECT a, b, sum(na - na * (xa + 1) / (na + 1) + xa * ln((xa + 1) / (na + 1)) + nb - nb * (xb + 1) / (nb + 1) + xb * ln((xb + 1) / (nb + 1))) AS distance FROM p GROUP BY 1, 2""", ["distance"])
def poisson_distance(t):
    return E.poisson_distance(counts(t))


@query("WITH p AS (SELECT n_nationkey AS k, n_nationkey * 37 % 100 AS x, n_nationkey * 53 % 90 AS y FROM nation) SELECT a.k AS a, b.k AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM p a, p b", ["distance"])
def sample_map(t):
    """Two coordinates from a matrix of distances: those of points in a plane come back."""
    k = F.col("n_nationkey")
    p = t.nation.select(k.alias("k"), (k * 37 % 100).alias("x"), (k * 53 % 90).alias("y"))

    def pairs(df, x, y):
        other = df.withColumnsRenamed({"k": "b", x: "_x", y: "_y"})
        d = F.sqrt(F.pow(F.col(x) - F.col("_x"), 2) + F.pow(F.col(y) - F.col("_y"), 2))
        return df.crossJoin(other).select(F.col("k").alias("a"), "b", d.alias("distance"))  # 25 nations

    return pairs(E.mds(pairs(p, "x", "y")).withColumnRenamed("sample", "k"), "dim1", "dim2")


def binomial_tail(u: str, k: str, n: str) -> str:
    """The beta tail I_u(k, n - k + 1) as a sum."""
    return f"list_sum([exp({log_choose(n, 'j')}) * {u} ** j * (1 - {u}) ** ({n} - j) FOR j IN range({k}, {n} + 1)])"


RHO = f"coalesce(list_min([{binomial_tail('u[k]', 'k', 'len(u)')} FOR k IN range(1, len(u) + 1) IF u[k] <= 0.25]), 1)"
DRAW = "list_sort([(('0x' || substr(md5(n || ':' || d || ':' || i || ':0'), 1, 8))::BIGINT::DOUBLE / 4294967296.0) FOR i IN range(1, n + 1)])"


@query(f"""WITH v AS (SELECT p_size AS gene, list_sort(list((p_partkey * 7919 % 1009 + 1) / 1010)) AS u FROM part WHERE p_partkey <= 200 GROUP BY 1), r AS (SELECT gene, len(u) AS n, {RHO} AS rho FROM v),
nl AS (SELECT n, {RHO} AS z FROM (SELECT n, {DRAW} AS u FROM (SELECT DISTINCT n FROM r), (SELECT unnest(range(1, 51)) AS d)))
SELECT gene, r.n, rho, (count(*) FILTER (z <= rho + 1e-12) + 1) / 51 AS pvalue FROM r JOIN nl ON nl.n = r.n GROUP BY ALL""", ["rho", "pvalue"])
def robust_rank(t):
    """Guides of the first two hundred numbers, which every scale has: a gene for each size."""
    x = t.part.where("p_partkey <= 200")
    return E.robust_rank(x.withColumnRenamed("p_size", "gene"), "gene", (F.col("p_partkey") * 7919 % 1009 + 1) / 1010, permutations=50)


# --- Variants ---------------------------------------------------------------------------------------------------------

MAF = "mf AS (SELECT 'p' || (l_partkey % 200) AS \"Hugo_Symbol\", 's' || l_suppkey AS \"Tumor_Sample_Barcode\", l_returnflag AS kind FROM lineitem WHERE l_quantity > 35)"


def maf(t):
    x = t.lineitem.where("l_quantity > 35")
    return x.select(F.concat(F.lit("p"), F.col("l_partkey") % 200).alias("Hugo_Symbol"), F.concat(F.lit("s"), "l_suppkey").alias("Tumor_Sample_Barcode"), F.col("l_returnflag").alias("kind"))


@query(f"WITH {MAF} SELECT s_nationkey AS nation, count(*) AS n_variants, count(DISTINCT \"Hugo_Symbol\") AS n_genes FROM mf JOIN supplier ON 's' || s_suppkey = \"Tumor_Sample_Barcode\" GROUP BY 1")
def maf_merge(t):
    x = maf(t).withColumn("nothing", F.lit(None).cast("string"))
    clinical = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("Tumor_Sample_Barcode"), F.col("s_nationkey").alias("nation"))
    merged = E.merge_mafs([x.where("kind = 'A'").drop("kind"), x.where("kind <> 'A'")], clinical)
    return E.maf_summary(merged, "nation") if "nothing" not in merged.columns else merged


def fisher(a: str, b: str, c: str, d: str) -> str:
    """Two-sided exact test of a table's cells."""
    log = lambda i: f"({log_choose(f'({a} + {b})', i)} + {log_choose(f'({c} + {d})', f'({a} + {c} - {i})')} - {log_choose(f'({a} + {b} + {c} + {d})', f'({a} + {c})')})"
    return f"least(1, list_sum([CASE WHEN {log('i')} <= {log(a)} + 1e-7 THEN exp({log('i')}) ELSE 0 END FOR i IN range(greatest(0, {a} - {d}), least({a} + {b}, {a} + {c}) + 1)]))"


@query(f"""WITH {MAF}, a AS (SELECT "Hugo_Symbol" AS gene, count(DISTINCT "Tumor_Sample_Barcode") AS a FROM mf WHERE kind = 'A' GROUP BY 1), b AS (SELECT "Hugo_Symbol" AS gene, count(DISTINCT "Tumor_Sample_Barcode") AS b FROM mf WHERE kind = 'R' GROUP BY 1),
n AS (SELECT count(DISTINCT "Tumor_Sample_Barcode") FILTER (kind = 'A') AS na, count(DISTINCT "Tumor_Sample_Barcode") FILTER (kind = 'R') AS nb FROM mf), j AS (SELECT gene, coalesce(a, 0) AS a, coalesce(b, 0) AS b, na, nb FROM a FULL JOIN b USING (gene), n),
o AS (SELECT *, (a + 0.5::DOUBLE) * (nb - b + 0.5::DOUBLE) / ((na - a + 0.5::DOUBLE) * (b + 0.5::DOUBLE)) AS odds_ratio, {fisher('a', '(na - a)', 'b', '(nb - b)')} AS pvalue FROM j) SELECT * FROM o WHERE odds_ratio > 1 AND pvalue < 0.5""", ["odds_ratio", "pvalue"])
def cohort_pvalues(t):
    x = maf(t)
    return E.compare_cohorts(x.where("kind = 'A'").withColumnRenamed("Hugo_Symbol", "gene"), x.where("kind = 'R'").withColumnRenamed("Hugo_Symbol", "gene"), "gene", "Tumor_Sample_Barcode", p=0.5)


@query(f"""WITH {MAF}, c AS (SELECT 's' || s_suppkey AS s, s_nationkey % 3 AS grp FROM supplier), h AS (SELECT DISTINCT "Hugo_Symbol" AS g, s, grp FROM mf JOIN c ON s = "Tumor_Sample_Barcode"), i AS (SELECT g, grp, count(*) AS mi FROM h GROUP BY 1, 2), t AS (SELECT g, count(*) AS m FROM h GROUP BY 1), z AS (SELECT grp, count(*) AS ni FROM c GROUP BY 1),
j AS (SELECT g AS "Hugo_Symbol", grp, mi AS mutated_in, ni AS n_in, m - mi AS mutated_out, (SELECT count(*) FROM c) - ni AS n_out FROM i JOIN t USING (g) JOIN z USING (grp)) SELECT *, {fisher('mutated_in', '(n_in - mutated_in)', 'mutated_out', '(n_out - mutated_out)')} AS pvalue FROM j""", ["pvalue"])
def clinical_enrichment(t):
    clinical = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("Tumor_Sample_Barcode"), (F.col("s_nationkey") % 3).alias("grp"))
    return E.clinical_enrichment(maf(t), clinical, "grp")


# --- Regions ----------------------------------------------------------------------------------------------------------


@query(f"WITH {IV}, {MERGE.format(by='sample, chrom', src='iv')}, al AS (SELECT 'all' AS sample, chrom, \"start\", \"end\" FROM iv), {MERGE.format(by='sample, chrom', src='al').replace('o AS (', 'o2 AS (', 1).replace('FROM o)', 'FROM o2)').replace('i AS (', 'i2 AS (', 1).replace('FROM i GROUP', 'FROM i2 GROUP').replace('m AS (', 'm2 AS (', 1)} SELECT sample, chrom, \"start\", \"end\" FROM m UNION ALL SELECT sample, chrom, \"start\", \"end\" FROM m2")
def consensus_beds(t):
    return I.consensus_beds(intervals(t), "sample")


GENE = "ge AS (SELECT 's' || s_suppkey AS chrom, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, (s_nationkey * 60 + 300)::BIGINT AS a, (s_nationkey * 60 + 500)::BIGINT AS b FROM supplier)"
AREAS = """ar AS (SELECT 'in_gene' AS area, chrom, a, b FROM ge UNION ALL SELECT 'flank_gene', chrom, a - 100, a - 1 FROM ge UNION ALL SELECT 'flank_gene', chrom, b + 1, b + 100 FROM ge
UNION ALL SELECT 'in_tss', chrom, CASE WHEN strand = '-' THEN b ELSE a END, CASE WHEN strand = '-' THEN b ELSE a END FROM ge UNION ALL SELECT 'flank_tss', chrom, t - 30, t - 1 FROM (SELECT chrom, CASE WHEN strand = '-' THEN b ELSE a END AS t FROM ge) UNION ALL SELECT 'flank_tss', chrom, t + 1, t + 30 FROM (SELECT chrom, CASE WHEN strand = '-' THEN b ELSE a END AS t FROM ge))"""


def gene_table(t):
    k = F.col("s_suppkey")
    return t.supplier.select(F.concat(F.lit("s"), k).alias("chrom"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("s_nationkey") * 60 + 300).cast("long").alias("start"), (F.col("s_nationkey") * 60 + 500).cast("long").alias("end"))


def reads(t):
    """Intervals with a key of their own: the columns that tell them apart."""
    return intervals(t).select(F.struct("l_orderkey", "l_linenumber", "chrom", "start", "end", "score").alias("read"), "chrom", "start", "end", "sample")


@query(f"WITH {IV}, {GENE}, {AREAS}, hit AS (SELECT DISTINCT area, iv.* FROM iv JOIN ar ON ar.chrom = iv.chrom AND a <= \"end\" AND \"start\" <= b), {MERGE.format(by='area, chrom', src='hit')} SELECT area, count(*) AS n, sum(\"end\" - \"start\" + 1)::BIGINT AS places FROM m GROUP BY 1")
def gene_regions(t):
    found = I.gene_regions(reads(t), gene_table(t), "read", 100, 30)
    out = None
    for name, df in found.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start") + 1).alias("places")).select(F.lit(name).alias("area"), "n", "places")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {IV}, {REG}, {GENE}, n AS (SELECT count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM rg WHERE rg.chrom = iv.chrom AND rg.\"start\" <= iv.\"end\" AND iv.\"start\" <= rg.\"end\")) AS body, count(*) FILTER (EXISTS (SELECT 1 FROM ge WHERE ge.chrom = iv.chrom AND a <= iv.\"end\" AND iv.\"start\" <= b)) AS gene FROM iv) SELECT total, body, gene, total / body AS total_of_body, total / gene AS total_of_gene, body / total AS body_of_total, body / gene AS body_of_gene, gene / total AS gene_of_total, gene / body AS gene_of_body FROM n", ["total_of_body", "total_of_gene", "body_of_total", "body_of_gene", "gene_of_total", "gene_of_body"])
def region_ratios(t):
    return I.region_ratios(reads(t), {"body": regions(t).select("chrom", "start", "end"), "gene": gene_table(t).select("chrom", "start", "end")}, "read")


REGION_PARTS = "pt AS (SELECT key, chrom, 1 AS body, \"start\" AS a, \"end\" AS b FROM rg UNION ALL SELECT key, chrom, 0, greatest(\"start\" - 100, 1), \"start\" - 1 FROM rg UNION ALL SELECT key, chrom, 0, \"end\" + 1, \"end\" + 100 FROM rg), rn AS (SELECT key, CASE WHEN sample = 'N' THEN 'ctrl' ELSE 'treated' END AS grp, sum(body) AS body, sum(1 - body) AS flank FROM pt JOIN iv ON iv.chrom = pt.chrom AND a <= \"end\" AND \"start\" <= b GROUP BY 1, 2)"


def sample_groups(t):
    return t.lineitem.select(F.col("l_returnflag").alias("sample")).distinct().withColumn("group", F.when(F.col("sample") == "N", "ctrl").otherwise("treated"))


@query(f"WITH {IV}, {REG}, {REGION_PARTS}, w AS (SELECT key, max(body / nullif(flank, 0)) FILTER (grp = 'ctrl') AS ctrl, max(body / nullif(flank, 0)) FILTER (grp = 'treated') AS treated FROM rn GROUP BY 1) SELECT *, treated - ctrl AS treated_diff FROM w", ["ctrl", "treated", "treated_diff"])
def region_matrix(t):
    return I.region_matrix(regions(t), reads(t).drop("read"), "key", "sample", sample_groups(t), "ctrl", ["ctrl", "treated"], 100, width=100)


@query("WITH w AS (SELECT p_brand, avg(p_retailprice) FILTER (p_size % 2 = 0) AS a, avg(p_retailprice) FILTER (p_size % 2 = 1) AS b FROM part GROUP BY 1) SELECT p_brand, a, b, a / b AS relative_diff FROM w", ["a", "b", "relative_diff"])
def relative_difference(t):
    return I.relative_difference(t.part.withColumn("g", F.when(F.col("p_size") % 2 == 0, "a").otherwise("b")), "g", ["p_brand"], "p_retailprice", "a", "b")


@query(f"WITH {IV}, {MERGE.format(by='chrom', src='iv')} SELECT m.chrom || ':' || m.\"start\" AS key, bool_or(sample = 'A') AS \"A\", bool_or(sample = 'R') AS \"R\" FROM m JOIN iv ON m.chrom = iv.chrom AND m.\"start\" <= iv.\"end\" AND iv.\"start\" <= m.\"end\" GROUP BY 1 HAVING bool_or(sample = 'A') OR bool_or(sample = 'R')")
def presence_matrix(t):
    merged = I.reduce_ranges(intervals(t), ["chrom"]).withColumn("key", F.concat_ws(":", "chrom", "start"))
    return I.presence_matrix(merged, intervals(t), "key", "sample", ["A", "R"]).select("key", "A", "R")


NOTES = ["Promoter (<=1kb)", "Exon (x, exon 2 of 5)", "Intron (y)", "Distal Intergenic", "3' UTR"]


@query(f"SELECT c AS category, sum(p_size)::BIGINT AS p_size, sum(p_retailprice) AS p_retailprice FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'Promoter' WHEN 3 THEN 'Distal' ELSE 'Gene Body' END AS c FROM part) GROUP BY 1", ["p_retailprice"])
def category_totals(t):
    note = F.element_at(F.array(*[F.lit(n) for n in NOTES]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return I.category_totals(t.part.withColumn("note", note), "note", ["p_size", "p_retailprice"])


SIGNAL = f"""{IV}, {REG}, g AS (SELECT key, chrom, bin, ("start" + "end") // 2 - 100 + bin * 20 AS a, ("start" + "end") // 2 - 100 + (bin + 1) * 20 - 1 AS b FROM rg, (SELECT unnest(range(0, 10))::INTEGER AS bin)),
sv AS (SELECT key, bin, sum(score * (least(b, "end") - greatest(a, "start") + 1)) / 20 AS value FROM g JOIN iv ON g.chrom = iv.chrom AND a <= "end" AND "start" <= b GROUP BY 1, 2), mx AS (SELECT key, bin, coalesce(value, 0) AS value FROM g LEFT JOIN sv USING (key, bin))"""


def matrix(t):
    return I.signal_matrix(regions(t), intervals(t), "key", 10, 100, width=50)


@query(f"WITH {SIGNAL}, s AS (SELECT key, avg(value) AS mean, median(value) AS median, max(value) AS max FROM mx GROUP BY 1) SELECT key, round(mean, 6) AS mean, row_number() OVER (ORDER BY round(max, 9) DESC, key) AS rank_max, round(median, 6) AS median FROM s", ["mean", "median"])
def signal_order(t):
    m = matrix(t).withColumn("value", F.round("value", 9))
    mean, median = I.matrix_order(m, "key", "mean").select("key", F.col("score").alias("mean")), I.matrix_order(m, "key", "median").select("key", F.col("score").alias("median"))
    top = I.matrix_order(m, "key", "max").select("key", F.col("rank").cast("long").alias("rank_max"))
    return top.join(mean, "key").join(median, "key")


@query(f"WITH {SIGNAL} SELECT bin, avg(value) AS mean, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99 FROM mx GROUP BY 1", ["mean", "p01", "p99"])
def signal_profile(t):
    return I.column_profile(matrix(t))


@query("WITH s AS (SELECT n_nationkey AS key, 10 * (n_nationkey % 3) + CASE WHEN n_nationkey % 3 = 1 THEN 1.5 ELSE 0 END + n_nationkey / 100 AS score FROM nation) SELECT key, score, 2 - key % 3 AS cluster, row_number() OVER (ORDER BY 2 - key % 3, score DESC, key) AS rank FROM s", ["score"])
def signal_clusters(t):
    """Rows of three shapes, a shape for a cluster."""
    k = F.col("n_nationkey")
    rows = t.nation.select(k.alias("key"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("bin"))
    m = rows.withColumn("value", 10.0 * (F.col("key") % 3) + F.when(F.col("key") % 3 == 1, F.col("bin")).otherwise(0) + F.col("key") / 100)
    return I.cluster_order(m, "key", 4).select("key", "score", F.col("cluster").cast("int").alias("cluster"), F.col("rank").cast("long").alias("rank"))


@query("SELECT l_linestatus AS condition, l_suppkey AS key, l_linenumber AS bin, avg(l_quantity * CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 4 END) AS value FROM lineitem GROUP BY 1, 2, 3", ["value"])
def replicate_profile(t):
    m = t.lineitem.select(F.col("l_linestatus").alias("condition"), F.col("l_returnflag").alias("sample"), F.col("l_suppkey").alias("key"), F.col("l_linenumber").alias("bin"), F.col("l_quantity").alias("value"))
    depths = t.lineitem.select(F.col("l_returnflag").alias("sample")).distinct().withColumn("reads", F.when(F.col("sample") == "A", 2e6).when(F.col("sample") == "N", 3e6).otherwise(4e6))
    return I.replicate_profile(m, depths)


@query(f"WITH {WALD} SELECT symbol AS peak, \"log2FoldChange\", padj, CASE WHEN padj < 0.5 AND \"log2FoldChange\" >= 0.1 THEN 'Gain' WHEN padj < 0.5 AND \"log2FoldChange\" <= -0.1 THEN 'Loss' ELSE 'NS' END AS class FROM res", ["log2FoldChange", "padj"])
def differential_binding(t):
    x = grouped(t).withColumnRenamed("symbol", "peak")
    return I.differential_binding(x, "grp", "ctrl", 0.1, 0.5).select("peak", "log2FoldChange", "padj", "class")


@query(f"WITH {RESULT} SELECT symbol, CASE WHEN \"log2FoldChange\" >= 1 AND c >= 1 THEN 'up' WHEN \"log2FoldChange\" <= -1 AND c >= 1 THEN 'down' WHEN \"log2FoldChange\" >= 1 THEN 'up_low' WHEN \"log2FoldChange\" <= -1 THEN 'down_low' ELSE 'others' END AS direction FROM (SELECT *, substr(symbol, 2)::INTEGER % 4 / 2 AS c FROM rs)")
def direction_class(t):
    return result(t).select("symbol", I.direction_class(F.col("log2FoldChange"), F.substring("symbol", 2, 20).cast("int") % 4 / 2).alias("direction"))


@query(f"WITH {RESULT}, pk AS (SELECT 'g' || l_partkey AS symbol, avg(l_discount * 10) AS fold_peak, count(*) AS n_peaks FROM lineitem WHERE l_tax > 0.04 GROUP BY 1) SELECT symbol, fold_peak, n_peaks, \"log2FoldChange\" AS lfc_rna, corr(fold_peak, \"log2FoldChange\") OVER () AS r FROM pk JOIN rs USING (symbol)", ["fold_peak", "lfc_rna", "r"])
def cross_expression(t):
    peaks = t.lineitem.select(F.concat(F.lit("g"), "l_partkey").alias("symbol"), (F.col("l_discount") * 10).alias("fold"), (F.col("l_tax") > 0.04).alias("promoter"))
    x = I.cross_expression(peaks, result(t))
    r = S.correlation_matrix(x, ["fold_peak", "lfc_rna"]).where("a = 'fold_peak' AND b = 'lfc_rna'").select("r")
    return x.crossJoin(F.broadcast(r))


@query(f"WITH {IV}, {REG} SELECT sample, count(*) AS reads, avg(EXISTS (SELECT 1 FROM rg WHERE rg.chrom = iv.chrom AND rg.\"start\" <= iv.\"end\" AND iv.\"start\" <= rg.\"end\")::INTEGER) AS frip FROM iv GROUP BY 1", ["frip"])
def frip_scores(t):
    return I.frip(reads(t), regions(t), "read", "sample")


@query(f"WITH {IV} SELECT sample, \"end\" - \"start\" + 1 AS length, count(*) AS n FROM iv GROUP BY 1, 2")
def fragment_lengths(t):
    return I.fragment_lengths(intervals(t), "sample")


BINS = f"{IV}, bn AS (SELECT sample, chrom, b AS bin, sum(score * (least(\"end\", (b + 1) * 50 - 1) - greatest(\"start\", b * 50) + 1)) / 50 AS value FROM (SELECT *, unnest(range(\"start\" // 50, \"end\" // 50 + 1)) AS b FROM iv) GROUP BY 1, 2, 3)"


@query(f"WITH {BINS} SELECT * FROM bn", ["value"])
def bin_signal(t):
    return I.bin_signal(intervals(t), "sample", 50)


@query(f"WITH {BINS}, r AS (SELECT sample, chrom, bin, rank() OVER (PARTITION BY sample ORDER BY round(value, 9)) + (count(*) OVER (PARTITION BY sample, round(value, 9)) - 1) / 2.0::DOUBLE AS r FROM bn) SELECT a.sample AS a, b.sample AS b, corr(a.r, b.r) AS r FROM r a JOIN r b USING (chrom, bin) GROUP BY 1, 2", ["r"])
def bin_correlation(t):
    """Correlation of the samples' ranks over the bins that both have."""
    from assayloom.operators.windows import average_rank

    x = I.bin_signal(intervals(t), "sample", 50).withColumn("value", F.round("value", 9))
    ranked = x.select(F.concat_ws(":", "chrom", "bin").alias("item"), "sample", average_rank(["sample"], F.col("value")).alias("r"))
    return S.sample_correlation(ranked, "item", "sample", "r")
