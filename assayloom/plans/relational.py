"""Joins, reshaping, order, sets, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions import strings
from assayloom.functions.nulls import clip, range_flag, ratio
from assayloom.operators import columns as C
from assayloom.operators import relational as R
from assayloom.plans.registry import query

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def natural_left_join(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return R.natural_left_join(t.orders.select("o_orderkey", "o_custkey"), c)


@query("SELECT n.n_name, n.n_regionkey, s.n_nationkey, s.s_suppkey FROM (SELECT s_suppkey, s_nationkey AS n_nationkey FROM supplier) s LEFT JOIN nation n USING (n_nationkey)")
def right_join_dim(t):
    return R.join_dimension(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), t.nation)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, nullif(l_tax, 0) AS tax FROM lineitem), d AS (SELECT nullif(l_tax, 0) AS tax, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, l.l_linenumber, l.tax, d.n FROM l LEFT JOIN d ON l.tax IS NOT DISTINCT FROM d.tax""")
def nullsafe_join(t):
    left = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return R.null_safe_join(left, left.groupBy("tax").agg(F.count(F.lit(1)).alias("n")), ["tax"])


@query("SELECT r.n_nationkey, r.n_x AS n_x_cust, s.n_x AS n_x_supp FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n_x FROM customer GROUP BY 1) r LEFT JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS n_x FROM supplier GROUP BY 1) s USING (n_nationkey)")
def join_suffix(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_x"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_x"))
    return R.join_suffixed(a, b, ["n_nationkey"], ("_cust", "_supp"))


@query("SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey")
def fan_out_join(t):
    return t.customer.join(t.supplier, F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_in(t):
    return R.semi(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def anti_in(t):
    return R.anti(t.customer, t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("SELECT coalesce(c.k, o.k) AS k, c.c_name, o.n FROM (SELECT c_custkey AS k, c_name FROM customer) c FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON c.k = o.k WHERE o.n IS NOT NULL")
def outer_drop(t):
    orders = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return R.outer_keep_right(t.customer.select(F.col("c_custkey").alias("k"), "c_name"), orders, ["k"], "n")


@query("SELECT k, a.n AS lines, b.n AS suppliers, c.n AS flags FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) a LEFT JOIN (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) b USING (k) LEFT JOIN (SELECT l_orderkey AS k, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1) c USING (k)")
def join_chain(t):
    k = F.col("l_orderkey").alias("k")
    li = t.lineitem
    return R.join_all([li.groupBy(k).agg(F.count(F.lit(1)).alias("lines")), li.groupBy(k).agg(F.count_distinct("l_suppkey").alias("suppliers")), li.groupBy(k).agg(F.count_distinct("l_returnflag").alias("flags"))], ["k"])


@query("SELECT c.c_custkey, h.o_totalprice, h.o_totalprice IS NOT NULL AS is_hit FROM customer c LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) h ON h.o_custkey = c.c_custkey")
def flag_members(t):
    return R.flag_members(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice"), "c_custkey")


ALIAS = """WITH dim AS (SELECT n_name AS approved_symbol, 'N' || n_nationkey AS alias_symbol, 'NATION_' || ((n_nationkey + 1) % 25) AS previous_symbol FROM nation),
names AS (SELECT approved_symbol AS nm, 0 AS r, approved_symbol AS t FROM dim UNION ALL SELECT previous_symbol, 1, approved_symbol FROM dim UNION ALL SELECT alias_symbol, 2, approved_symbol FROM dim),
best AS (SELECT nm, arg_min(t, r * 1000 + length(t)) AS t FROM names GROUP BY nm),
x AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'NATION_' || s_nationkey WHEN 1 THEN 'N' || s_nationkey ELSE 'X' || s_nationkey END AS symbol FROM supplier)
SELECT s_suppkey, coalesce(best.t, symbol) AS symbol, symbol AS symbol_old FROM x LEFT JOIN best ON x.symbol = best.nm"""


@query(ALIAS)
def alias_resolution(t):
    key = F.col("n_nationkey")
    dim = t.nation.select(F.col("n_name").alias("approved_symbol"), F.concat(F.lit("N"), key).alias("alias_symbol"), F.concat(F.lit("NATION_"), (key + 1) % 25).alias("previous_symbol"))
    m, n = F.col("s_suppkey") % 3, F.col("s_nationkey")
    x = t.supplier.select("s_suppkey", F.when(m == 0, F.concat(F.lit("NATION_"), n)).when(m == 1, F.concat(F.lit("N"), n)).otherwise(F.concat(F.lit("X"), n)).alias("symbol"))
    return R.resolve_alias(x, "symbol", dim)


@query("SELECT a.l_suppkey AS id, b.l_suppkey AS id_b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM (SELECT l_suppkey, avg(l_quantity) AS x, avg(l_discount) * 100 AS y FROM lineitem GROUP BY 1) a, (SELECT l_suppkey, avg(l_quantity) AS x, avg(l_discount) * 100 AS y FROM lineitem GROUP BY 1) b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 0.25", ["distance"])
def theta_join_grid(t):
    """Sums are exact and the bound is tested on them, so that a pair at a distance of just the bound is none in any order of rows."""
    exact = lambda c: F.sum(F.col(c).try_cast("decimal(38,18)"))
    sums = [exact("l_quantity").cast("double").alias("q"), (exact("l_discount") * 100).cast("double").alias("d"), F.count("l_quantity").cast("double").alias("n"), F.count("l_discount").cast("double").alias("m")]
    finite = F.abs(F.avg("l_quantity")) + F.abs(F.avg("l_discount")) < float("inf")  # false for NaN too
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(*sums, finite.alias("f")).where("f").select("id", (F.col("q") / F.col("n")).alias("x"), (F.col("d") / F.col("m")).alias("y"), "q", "d", "n", "m")
    near = R.near_pairs(p, p, 0.25 + 1e-9, ("id",), ("x", "y"))
    # Both sides times n * n_b: whole numbers for whole quantities and discounts of whole percents.
    return near.where("pow(q * n_b - q_b * n, 2) + pow((d * m_b - d_b * m) * ((n * n_b) / (m * m_b)), 2) < pow(0.25D * (n * n_b), 2)").select("id", "id_b", "distance")


# --- Reshaping --------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_quantity, l_extendedprice, l_discount, l_tax))")
def unpivot_multi(t):
    return R.longer(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("SELECT l_linestatus, 'A' AS key, sum(l_quantity) FILTER (l_returnflag = 'A') AS x, sum(l_tax) FILTER (l_returnflag = 'A') AS y FROM lineitem GROUP BY 1 UNION ALL SELECT l_linestatus, 'N', sum(l_quantity) FILTER (l_returnflag = 'N'), sum(l_tax) FILTER (l_returnflag = 'N') FROM lineitem GROUP BY 1", ["x", "y"])
def unpivot_names_parts(t):
    f = lambda c, v: F.sum(F.when(F.col("l_returnflag") == v, F.col(c)))
    wide = t.lineitem.groupBy("l_linestatus").agg(f("l_quantity", "A").alias("A_x"), f("l_tax", "A").alias("A_y"), f("l_quantity", "N").alias("N_x"), f("l_tax", "N").alias("N_y"))
    return R.longer_multi(wide, ["l_linestatus"])


@query("SELECT o_orderpriority, median(o_totalprice) FILTER (o_orderstatus = 'F') AS med_F, median(o_totalprice) FILTER (o_orderstatus = 'O') AS med_O, median(o_totalprice) FILTER (o_orderstatus = 'P') AS med_P FROM orders GROUP BY 1", ["med_F", "med_O", "med_P"])
def median_pivot(t):
    return R.wider(t.orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "o_totalprice", F.median, "med_")


@query("SELECT l_suppkey, " + ", ".join(f"sum(l_quantity) FILTER (l_returnflag = '{f}') AS qty_{f}, count(*) FILTER (l_returnflag = '{f}') AS n_{f}" for f in "ANR") + " FROM lineitem GROUP BY 1", [f"qty_{f}" for f in "ANR"])
def pivot_glue(t):
    return R.wider_multi(t.lineitem, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], {"qty": F.sum("l_quantity"), "n": F.count(F.lit(1))}, "{value}_{name}")


@query("SELECT p_partkey, concat_ws('|', p_brand, p_type, p_size) AS label FROM part")
def unite(t):
    return t.part.select("p_partkey", R.unite(["p_brand", "p_type", "p_size"], "|").alias("label"))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS kind, CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 2) END AS number, NULL::VARCHAR AS rest FROM customer")
def separate_delim(t):
    return t.customer.select("c_custkey", *R.separate(F.col("c_name"), "#", ["kind", "number", "rest"]))


@query("SELECT p_partkey, nullif(regexp_extract(p_brand, '^([A-Za-z]+)#([0-9]+)$', 1), '') AS word, nullif(regexp_extract(p_brand, '^([A-Za-z]+)#([0-9]+)$', 2), '') AS number, substr(p_brand, 1, 2) AS head, substr(p_brand, 3, 3) AS tail FROM part")
def separate_regex_position(t):
    return t.part.select("p_partkey", *R.separate_regex(F.col("p_brand"), [("word", "[A-Za-z]+"), (None, "#"), ("number", "[0-9]+")]), *R.separate_position(F.col("p_brand"), [("head", 2), ("tail", 3)]))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def nest_unnest(t):
    return R.unnest(R.nest(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"]))


@query("SELECT n_nationkey, k, v FROM (SELECT n_nationkey, unnest([{'k': 'name', 'v': n_name}, {'k': 'region', 'v': n_regionkey::VARCHAR}], recursive := true) FROM nation)")
def enframe(t):
    m = t.nation.select("n_nationkey", F.create_map(F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string")).alias("m"))
    return m.select("n_nationkey", F.explode("m").alias("k", "v"))


@query("SELECT a.l_returnflag, b.o_orderpriority FROM (SELECT DISTINCT l_returnflag FROM lineitem) a, (SELECT DISTINCT o_orderpriority FROM orders) b")
def crossing(t):
    return R.crossing(t.lineitem.select("l_returnflag"), t.orders.select("o_orderpriority"))


@query("SELECT r_regionkey, n_nationkey FROM region, nation")
def expand_grid(t):
    return R.expand_grid(t.region.select("r_regionkey"), t.nation.select("n_nationkey"))


@query("SELECT n_nationkey, i AS position, " + ", ".join(f"(c = '{a}')::INTEGER AS {a}" for a in "AINOT") + " FROM (SELECT n_nationkey, unnest(range(1, length(n_name) + 1))::INTEGER AS i, unnest(string_split(n_name, '')) AS c FROM nation)")
def one_hot(t):
    return R.one_hot(t.nation, ["n_nationkey"], "n_name", "AINOT")


# --- Order and sampling -----------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_k_per_group(t):
    return R.top_k(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) <= 1")
def slice_min_ties(t):
    return R.top_k(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_suppkey"], [F.col("l_quantity")], 1, ties=True)


@query("SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def distinct_first(t):
    return R.distinct_first(t.part.select("p_brand", "p_partkey", "p_name"), ["p_brand"], [F.col("p_partkey")])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def global_top_n(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT p_brand, row_number() OVER (ORDER BY regexp_extract(p_brand, '^([^0-9]*)', 1), regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT) AS pos FROM (SELECT DISTINCT p_brand FROM part)")
def natural_sort(t):
    from pyspark.sql import Window

    return t.part.select("p_brand").distinct().select("p_brand", F.row_number().over(Window.orderBy(strings.natural_key(F.col("p_brand")))).cast("long").alias("pos"))


HASH = "('0x' || substr(md5({k}::VARCHAR || ':{s}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0"


@query(f"SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY {HASH.format(k='p_partkey', s=3)}, p_partkey) <= 5")
def sample_per_class(t):
    return R.sample_per_class(t.part.select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 5, 3)


@query(f"SELECT doc_id, CASE WHEN u < 0.2 THEN 1 WHEN u < 0.5 THEN 2 ELSE 3 END AS rep FROM (SELECT doc_id, {HASH.format(k='doc_id', s=0)} AS u FROM documents)")
def split_ratio(t):
    return R.split_ratio(t.documents.select("doc_id"), "doc_id", [0.2, 0.3, 0.5])


@query(f"SELECT vec_id, label, CASE WHEN {HASH.format(k='vec_id', s=0)} < 0.75 THEN 'train' ELSE 'test' END AS \"set\" FROM embeddings")
def train_test_split(t):
    return R.split_train(t.embeddings.select("vec_id", "label"), "vec_id")


@query("SELECT rep, p_partkey FROM (SELECT p_partkey, unnest(range(1, 4))::INTEGER AS rep FROM part) QUALIFY row_number() OVER (PARTITION BY rep ORDER BY md5(p_partkey || ':' || rep || ':0'), p_partkey) <= 50")
def sample_repeats(t):
    return R.sample_repeats(t.part.select("p_partkey"), "p_partkey", 50, 3).select("rep", "p_partkey")


# --- Sets -------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS k, c_acctbal AS bal, 'customer' AS source, NULL::VARCHAR AS note FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier', s_name FROM supplier")
def union_tagged(t):
    return R.union_tagged({"customer": t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), "supplier": t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("note"))})


def _parts(t, flag):
    return t.lineitem.where(F.col("l_returnflag") == flag).select("l_partkey")


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersect(t):
    return _parts(t, "A").intersect(_parts(t, "R"))


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
def set_diff(t):
    return _parts(t, "A").subtract(t.lineitem.where("l_returnflag = 'R' AND l_quantity > 25").select("l_partkey"))


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_union(t):
    return _parts(t, "A").union(_parts(t, "R")).distinct()


@query("SELECT in_A, in_N, in_R, count(*) AS n FROM (SELECT l_partkey, bool_or(l_returnflag = 'A') AS in_A, bool_or(l_returnflag = 'N') AS in_N, bool_or(l_returnflag = 'R') AS in_R FROM lineitem WHERE l_quantity > 45 GROUP BY 1) GROUP BY 1, 2, 3")
def upset_counts(t):
    return R.membership_counts(t.lineitem.where("l_quantity > 45"), "l_partkey", "l_returnflag", ["A", "N", "R"])


# --- Projections ------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity * 0.65 AS l_quantity, l_extendedprice * 0.65 * 0.65 AS l_extendedprice FROM lineitem", ["l_quantity", "l_extendedprice"])
def pixel_to_um(t):
    return C.pixel_to_um(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), "quantity", "price", 0.65)


@query("SELECT l_discount, l_tax, l_quantity FROM lineitem WHERE l_discount > 0.02 AND l_tax > 0.02 AND (l_discount > 0.07 OR l_tax > 0.07)")
def filter_all_any(t):
    both = C.filter_all(t.lineitem.select("l_discount", "l_tax", "l_quantity"), ["l_discount", "l_tax"], lambda c: c > 0.02)
    return C.filter_any(both, ["l_discount", "l_tax"], lambda c: c > 0.07)


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' WHEN p_type = 'PROMO' THEN 'promo' ELSE 'large' END AS class FROM part")
def case_when(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", C.case_when([(s < 10, "small"), (s < 30, "medium"), (F.col("p_type") == "PROMO", "promo")], "large").alias("class"))


@query("SELECT l_orderkey, l_linenumber, greatest(l_quantity - l_discount * 100 * 2, 0) AS l_quantity FROM lineitem", ["l_quantity"])
def subtract_background(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 100).alias("bg"), F.lit(2.0).alias("area"))
    return C.subtract_background(x, {"l_quantity": "bg"}, "area").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS clipped, CASE WHEN c_acctbal < 0 OR c_acctbal > 5000 THEN 'out' ELSE 'in' END AS flag, c_acctbal / nullif(c_nationkey, 0) AS r FROM customer", ["r"])
def clip_ratio(t):
    x = F.col("c_acctbal")
    return t.customer.select("c_custkey", clip(x, 0, 5000).alias("clipped"), range_flag(x, 0, 5000).alias("flag"), ratio(x, F.col("c_nationkey")).alias("r"))


@query("SELECT l_orderkey, l_linenumber, (coalesce(nullif(l_tax, 0), 0) + coalesce(nullif(l_discount, 0), 0)) / nullif((nullif(l_tax, 0) IS NOT NULL)::INTEGER + (nullif(l_discount, 0) IS NOT NULL)::INTEGER, 0) AS m FROM lineitem", ["m"])
def row_mean(t):
    from assayloom.functions.maths import row_mean as rm

    x = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_tax", F.lit(0.0)).alias("a"), F.nullif("l_discount", F.lit(0.0)).alias("b"))
    return x.select("l_orderkey", "l_linenumber", rm(["a", "b"]).alias("m"))


@query("SELECT p_partkey, p_name FROM part")
def remove_constant(t):
    """Constant and empty columns go, names are cleaned."""
    x = t.part.select(F.col("p_partkey").alias("P Partkey"), F.col("p_name").alias("pName"), F.lit(1).alias("one"), F.lit(None).cast("string").alias("none"))
    return C.clean_names(C.remove_empty(C.remove_constant(x)))


@query("SELECT event_id, flag, mapq, rname FROM (SELECT event_id, (CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1026 WHEN 'error' THEN 3 ELSE 83 END)::INTEGER AS flag, (value::BIGINT % 60)::INTEGER AS mapq, 'chr' || (CASE WHEN user_id % 25 = 0 THEN 'M' WHEN user_id % 25 = 23 THEN 'X' ELSE (user_id % 25)::VARCHAR END) AS rname FROM events) WHERE flag & 2 = 2 AND flag & 1804 = 0 AND mapq >= 30 AND regexp_matches(rname, '^(chr)?([0-9]+|X|Y)$')")
def good_reads(t):
    e, m = F.col("event_type"), F.col("user_id") % 25
    x = t.events.select("event_id", F.when(e == "view", 2).when(e == "click", 1026).when(e == "error", 3).otherwise(83).alias("flag"), (F.bround("value").cast("long") % 60).cast("int").alias("mapq"), F.concat(F.lit("chr"), F.when(m == 0, "M").when(m == 23, "X").otherwise(m.cast("string"))).alias("rname"))
    return C.good_reads(x)
