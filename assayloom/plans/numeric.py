"""Aggregates, windows, normalisation and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions import maths
from assayloom.operators import aggregate as A
from assayloom.operators import stats as S
from assayloom.operators import windows as W
from assayloom.plans.registry import query

LI = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query("""WITH c AS (SELECT l_linestatus, median(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT l_returnflag, l_linestatus, avg(l_extendedprice / nullif(m, 0)) AS mean_fc, count(*) AS n FROM lineitem LEFT JOIN c USING (l_linestatus) GROUP BY 1, 2""", ["mean_fc"])
def fold_change(t):
    out = S.control_median_ratio(t.lineitem.select("l_returnflag", "l_linestatus", "l_extendedprice"), ["l_linestatus"], "l_extendedprice", F.col("l_returnflag") == "N")
    return out.groupBy("l_returnflag", "l_linestatus").agg(F.avg("value_ratio").alias("mean_fc"), F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT l_linestatus, avg(l_extendedprice) AS a, avg(l_quantity) AS b FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, log2(l_extendedprice / (a + 1)) AS "l_extendedprice_log2FC", log2(l_quantity / (b + 1)) AS "l_quantity_log2FC" FROM lineitem LEFT JOIN c USING (l_linestatus)""", ["l_extendedprice_log2FC", "l_quantity_log2FC"])
def log2_fold_change(t):
    x = S.fold_change(t.lineitem.select(*LI), ["l_linestatus"], ["l_extendedprice", "l_quantity"], F.col("l_returnflag") == "N", log=True, const=1.0)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice_log2FC", "l_quantity_log2FC")


@query("WITH c AS (SELECT p_brand, median(p_retailprice) AS m FROM part WHERE p_type = 'PROMO' GROUP BY 1) SELECT p_partkey, p_retailprice - m AS delta FROM part LEFT JOIN c USING (p_brand)", ["delta"])
def shift_to_reference(t):
    return S.shift_to_reference(t.part, ["p_brand"], "p_retailprice", F.col("p_type") == "PROMO", "delta").select("p_partkey", "delta")


@query("SELECT event_id, value / nullif(avg(CASE WHEN event_type = 'view' THEN value END) OVER (PARTITION BY user_id), 0) AS ratio FROM events", ["ratio"])
def control_ratio_window(t):
    return W.control_ratio(t.events.select("event_id", "user_id", "event_type", "value"), ["user_id"], "value", F.col("event_type") == "view").select("event_id", "ratio")


@query("""WITH m AS (SELECT *, min(l_quantity) OVER (PARTITION BY l_suppkey) AS low FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(avg(CASE WHEN l_quantity = low THEN l_extendedprice END) OVER (PARTITION BY l_suppkey), 0) AS ratio FROM m""", ["ratio"])
def lowest_dose_ratio(t):
    return W.lowest_dose_ratio(t.lineitem.select(*LI), ["l_suppkey"], "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "ratio")


TRIM = """SELECT o_orderpriority, avg(o_totalprice) AS o_totalprice FROM (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
WHERE k > floor(n * 0.05) AND k <= n - floor(n * 0.05) GROUP BY 1"""


@query(TRIM, ["o_totalprice"])
def trimmed_mean(t):
    return A.trimmed_mean(t.orders, ["o_orderpriority"], ["o_totalprice"], 0.05, ["o_orderkey"])


@query(TRIM, ["o_totalprice"])
def trimmed_mean_array(t):
    return t.orders.groupBy("o_orderpriority").agg(A.trimmed_mean_agg("o_totalprice", 0.05).alias("o_totalprice"))


@query("""WITH q AS (SELECT *, quantile_cont(l_extendedprice, 0.25) OVER w AS a, quantile_cont(l_extendedprice, 0.75) OVER w AS b, quantile_cont(l_quantity, 0.25) OVER w AS c, quantile_cont(l_quantity, 0.75) OVER w AS d FROM lineitem WINDOW w AS (PARTITION BY l_suppkey))
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM q WHERE l_extendedprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a) AND l_quantity BETWEEN c - 0.5 * (d - c) AND d + 0.5 * (d - c)""")
def iqr_outlier_filter(t):
    return W.remove_outliers(t.lineitem.select(*LI), ["l_suppkey"], ["l_extendedprice", "l_quantity"], 0.5).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_samp(c_acctbal) OVER w, 0) AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)", ["z"])
def zscore_long(t):
    return W.zscore(t.customer, ["c_mktsegment"], "c_acctbal").select("c_custkey", "z")


@query("SELECT event_id, sum(value) OVER (PARTITION BY event_type ORDER BY value, event_id) / sum(value) OVER (PARTITION BY event_type) AS cdf FROM events", ["cdf"])
def cdf_window(t):
    return W.cdf(t.events, ["event_type"], ["value", "event_id"], "value").select("event_id", "cdf")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) / count(*) OVER (PARTITION BY event_type) AS share_rows, sum(value) OVER (PARTITION BY event_type ORDER BY value DESC, event_id) / sum(value) OVER (PARTITION BY event_type) AS share_total FROM events", ["share_rows", "share_total"])
def lorenz_curve(t):
    return W.lorenz(t.events, ["event_type"], "value", ["event_id"]).select("event_id", "share_rows", "share_total")


@query("WITH b AS (SELECT event_type, floor(value / 10)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, bin, n, sum(n) OVER (PARTITION BY event_type ORDER BY bin)::DOUBLE / sum(n) OVER (PARTITION BY event_type)::DOUBLE AS cdf FROM b", ["cdf"])
def cut_width_hist(t):
    return W.binned_cdf(t.events, ["event_type"], "value", 10)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) WHERE (k - 1) % 7 = 0")
def every_kth(t):
    return W.every_kth(t.events, ["event_type"], ["ts", "event_id"], 7).select("event_id")


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS r FROM part", ["r"])
def rank_average(t):
    return t.part.select("p_partkey", W.average_rank(["p_brand"], F.col("p_size")).alias("r"))


@query("SELECT row, col, row_number() OVER (ORDER BY row, CASE WHEN row % 2 = 0 THEN -col ELSE col END) AS visit FROM (SELECT ((p_partkey % 96) // 12 + 1)::INTEGER AS row, (p_partkey % 12 + 1)::INTEGER AS col FROM part GROUP BY ALL)")
def serpentine(t):
    k = F.col("p_partkey")
    wells = t.part.select((F.floor(k % 96 / 12) + 1).cast("int").alias("row"), (k % 12 + 1).cast("int").alias("col")).distinct()
    return W.serpentine(wells, "row", "col", "lr").withColumn("visit", F.col("visit").cast("long"))


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) // 96 + 1)::INTEGER AS plate_number, ((row_number() OVER (ORDER BY p_partkey) - 1) % 96 + 1)::INTEGER AS position FROM part")
def plate_chunks(t):
    return W.to_plates(t.part.select("p_partkey"), ["p_partkey"], 96)


# --- Aggregates -------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS cell_count, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2", ["l_discount", "l_tax", "l_quantity"])
def summarize_to_field(t):
    return A.summarize_field(t.lineitem, ["l_returnflag", "l_linestatus", "not_there"], ["l_discount", "l_tax"], ["l_quantity"])


@query("SELECT l_returnflag, avg(l_quantity) AS l_quantity_mean, stddev_samp(l_quantity) AS l_quantity_sd, stddev_samp(l_quantity) / sqrt(count(l_quantity)) AS l_quantity_se FROM lineitem GROUP BY 1", ["l_quantity_mean", "l_quantity_sd", "l_quantity_se"])
def summarize_mean_sd(t):
    return A.mean_sd(t.lineitem, ["l_returnflag"], ["l_quantity"])


@query("SELECT user_id, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.95) AS q95 FROM events GROUP BY 1", ["q05", "q50", "q95"])
def quantiles(t):
    return A.quantiles(t.events, ["user_id"], "value", [0.05, 0.5, 0.95])


@query("WITH q AS (SELECT user_id, value, quantile_cont(value, 0.05) OVER (PARTITION BY user_id) AS a, quantile_cont(value, 0.95) OVER (PARTITION BY user_id) AS b FROM events) SELECT user_id, sum(value) FILTER (value > a AND value < b) AS value FROM q GROUP BY 1", ["value"])
def quantile_trimmed_sum(t):
    return A.quantile_trimmed_sum(t.events, ["user_id"], "value")


@query("WITH m AS (SELECT o_orderstatus, o_custkey, count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_custkey, o_orderkey FROM orders) GROUP BY 1, 2) SELECT o_orderstatus, count(*) AS n_mid, sum(n)::BIGINT AS n_inner FROM m GROUP BY 1")
def nested_counts(t):
    return A.nested_counts(t.orders, ["o_orderstatus", "o_custkey", "o_orderkey"], ["o_orderstatus", "o_custkey"], ["o_orderstatus"])


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names, count(DISTINCT n_name) AS n FROM nation GROUP BY 1")
def string_agg_sorted(t):
    return t.nation.groupBy("n_regionkey").agg(A.joined_text("n_name").alias("names"), F.count_distinct("n_name").alias("n"))


@query("SELECT l_orderkey, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem GROUP BY 1")
def span_union(t):
    return A.span(t.lineitem.select("l_orderkey", F.col("l_shipdate").alias("first_day"), F.col("l_shipdate").alias("last_day")), ["l_orderkey"], "first_day", "last_day")


@query("""WITH s AS (SELECT l_orderkey, sum(l_discount) AS spot_total FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey AS l_orderkey, o_totalprice / 400000 AS v, coalesce(spot_total, 0) AS spot_total FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT l_orderkey, spot_total, coalesce(spot_total / nullif(v, 0), 0) AS spot_fraction FROM j WHERE coalesce(spot_total / nullif(v, 0), 0) < 1""", ["spot_total", "spot_fraction"])
def spot_fraction(t):
    cells = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 400000).alias("v"))
    return A.spot_fraction(cells, t.lineitem, ["l_orderkey"], "v", "l_discount").select("l_orderkey", "spot_total", "spot_fraction")


@query("SELECT l_partkey, sum(l_quantity) AS l_quantity, sum(l_tax) AS l_tax FROM lineitem GROUP BY 1 HAVING sum(l_quantity) + sum(l_tax) > 800", ["l_quantity", "l_tax"])
def sum_by_gene(t):
    return A.sum_by_gene(t.lineitem, "l_partkey", ["l_quantity", "l_tax"], 800)


@query("SELECT l_partkey, (sum(l_tax) > 0)::INTEGER AS l_tax, (sum(l_discount) > 0)::INTEGER AS l_discount FROM lineitem GROUP BY 1")
def binarise(t):
    return A.binarise(t.lineitem, "l_partkey", ["l_tax", "l_discount"])


@query("WITH n AS (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, count(*) AS \"groups\", avg(n) AS mean_members, min(n) AS min_members, max(n) AS max_members FROM n GROUP BY 1", ["mean_members"])
def group_sizes(t):
    return A.group_sizes(t.orders, ["o_custkey"], ["o_orderstatus"])


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, sum((2 * k - n - 1) * value) / (max(n) * sum(value)) AS gini, 100 * avg((value = 0)::INTEGER) AS zero_pct, sum(value) AS total FROM r GROUP BY 1", ["gini", "zero_pct", "total"])
def gini(t):
    return A.gini(t.events, ["event_type"], "value", ["event_id"])


@query("SELECT o_orderkey, round_even(o_custkey * 1000 * (o_custkey % 97 / 97), 0)::BIGINT AS peak_reads, o_custkey * 1000 - round_even(o_custkey * 1000 * (o_custkey % 97 / 97), 0)::BIGINT AS out_reads FROM orders")
def peak_reads(t):
    x = t.orders.select("o_orderkey", (F.col("o_custkey") * 1000).alias("reads"), (F.col("o_custkey") % 97 / 97).alias("frip"))
    return A.peak_reads(x).select("o_orderkey", "peak_reads", "out_reads")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


# --- Tests and correlation --------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT l_linestatus, l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1, 2), c AS (SELECT l_linestatus, n AS n0, m AS m0, v AS v0 FROM m WHERE l_returnflag = 'N')
SELECT l_linestatus, l_returnflag, (m - m0) / sqrt(v / n + v0 / n0) AS t, (v / n + v0 / n0) ** 2 / ((v / n) ** 2 / (n - 1) + (v0 / n0) ** 2 / (n0 - 1)) AS df FROM m JOIN c USING (l_linestatus) WHERE l_returnflag <> 'N'""", ["t", "df"])
def welch_t(t):
    return S.welch(t.lineitem, ["l_linestatus"], "l_returnflag", "N", "l_quantity", pvalue=False)


@query("""WITH g AS (SELECT user_id % 10 AS grp, value, sum((event_type = 'view')::INTEGER) AS a, sum((event_type = 'click')::INTEGER) AS b FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
c AS (SELECT grp, sum(a) OVER (PARTITION BY grp ORDER BY value) AS ca, sum(b) OVER (PARTITION BY grp ORDER BY value) AS cb, sum(a) OVER (PARTITION BY grp) AS na, sum(b) OVER (PARTITION BY grp) AS nb FROM g)
SELECT grp, max(abs(ca::DOUBLE / na::DOUBLE - cb::DOUBLE / nb::DOUBLE)) AS D, max(na)::BIGINT AS n1, max(nb)::BIGINT AS n2 FROM c GROUP BY 1""", ["D"])
def ks_two_sample(t):
    e = t.events.where(F.col("event_type").isin("view", "click")).select((F.col("user_id") % 10).alias("grp"), "value", "event_type")
    return S.ks_two_sample(e, ["grp"], "value", F.col("event_type") == "view").drop("pvalue")


@query("""WITH v AS (SELECT user_id % 10 AS grp, value, event_type = 'view' AS f FROM events WHERE event_type IN ('view', 'click')), r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY value) + (count(*) OVER (PARTITION BY grp, value) - 1) / 2.0::DOUBLE AS r FROM v),
t AS (SELECT grp, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT grp, value, count(*)::DOUBLE AS t FROM v GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT grp, any_value(ties) AS ties, sum(r) FILTER (f) AS s, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2 FROM r JOIN t USING (grp) GROUP BY 1)
SELECT grp, n1, n2, s - n1 * (n1 + 1) / 2 AS U, (s - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s""", ["U", "z"])
def rank_sum(t):
    e = t.events.where(F.col("event_type").isin("view", "click")).select((F.col("user_id") % 10).alias("grp"), "value", "event_type")
    return S.rank_sum(e, ["grp"], "value", F.col("event_type") == "view", pvalue=False)


NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a in NUM for b in NUM), ["r"])
def corr_matrix(t):
    return S.correlation_matrix(t.lineitem, list(NUM))


@query("WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0::DOUBLE AS y FROM part) SELECT p_brand, corr(x, y) AS spearman FROM r GROUP BY 1", ["spearman"])
def spearman(t):
    return S.spearman(t.part, ["p_brand"], "p_size", "p_retailprice")


@query("SELECT a.p_brand, avg(sign((a.p_size - b.p_size) * (a.p_retailprice - b.p_retailprice))) AS tau FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey GROUP BY 1", ["tau"])
def kendall(t):
    return S.kendall(t.part, ["p_brand"], "p_partkey", "p_size", "p_retailprice")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_extendedprice % 1000 + 1) / 1001 AS p FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY p, l_orderkey, l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_suppkey) AS m FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, p, least(min(p * m / k) OVER (PARTITION BY l_suppkey ORDER BY k DESC), 1) AS padj FROM k""", ["p", "padj"])
def bh_adjust(t):
    p = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ((F.col("l_extendedprice") % 1000 + 1) / 1001).alias("p"))
    return S.bh_adjust(p, ["l_suppkey"], "p", ["l_orderkey", "l_linenumber", "l_partkey"]).drop("l_suppkey")


@query("SELECT vec_id, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x FROM (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings)", ["x"])
def minmax_scale(t):
    return S.minmax_scale(t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("x")), "x")


@query("SELECT user_id, floor(value / 50)::BIGINT AS dose, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS se FROM events GROUP BY 1, 2", ["mean", "se"])
def dose_summary(t):
    return S.dose_summary(t.events.withColumn("dose", F.floor(F.col("value") / 50).cast("long")), ["user_id"], "dose", "value")


@query("WITH m AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY 1, 2) SELECT user_id, 100 * (1 - min(m) / max(m)) AS top_inhibition FROM m GROUP BY 1", ["top_inhibition"])
def top_inhibition(t):
    return S.top_inhibition(t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("mean")), ["user_id"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice = 0 THEN 0 ELSE round(l_extendedprice * 10.0 ** (2 - floor(log10(l_extendedprice)))) / 10.0 ** (2 - floor(log10(l_extendedprice))) END AS s, log2((l_quantity + 1) / (l_tax + 1)) AS lfc FROM lineitem", ["s", "lfc"])
def signif_lfc(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", maths.signif(F.col("l_extendedprice"), 3).alias("s"), maths.log2_fold(F.col("l_quantity"), F.col("l_tax")).alias("lfc"))


SQUARE = [(0.0, 0.0), (30.0, 5.0), (45.0, 45.0), (5.0, 30.0)]


@query("SELECT l_orderkey, l_linenumber, l_partkey, (" + " + ".join(f"(CASE WHEN ({b} > y) <> ({d} > y) AND x < ({c} - {a}) * (y - {b}) / nullif({d} - {b}, 0) + {a} THEN 1 ELSE 0 END)" for (a, b), (c, d) in zip(SQUARE, SQUARE[1:] + SQUARE[:1], strict=True)) + ") % 2 = 1 AS inside FROM (SELECT *, l_quantity::DOUBLE AS x, l_discount * 500 AS y FROM lineitem)")
def point_in_polygon(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 500).alias("y"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", maths.point_in_polygon("x", "y", SQUARE).alias("inside"))
