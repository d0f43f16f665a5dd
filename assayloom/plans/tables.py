"""Plates, catalogues, identifiers, vectors, models and event windows on driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions import maths, strings
from assayloom.operators import catalog as K
from assayloom.operators import chem as H
from assayloom.operators import plates
from assayloom.plans.registry import query
from assayloom.streaming import incremental


@query("SELECT p_partkey, chr((65 + (p_partkey % 96) // 12)::INTEGER) || (p_partkey % 12 + 1) AS well, chr((65 + (p_partkey % 96) // 12)::INTEGER) AS letter, (p_partkey % 12 + 1)::INTEGER AS number FROM part")
def plate_wells(t):
    k = F.col("p_partkey")
    w = t.part.select("p_partkey", strings.well_name((F.floor(k % 96 / 12) + 1).cast("int"), (k % 12 + 1).cast("int")).alias("well"))
    return w.select("p_partkey", "well", strings.well_row(F.col("well")).alias("letter"), strings.well_col(F.col("well")).alias("number"))


@query("SELECT c_custkey, regexp_replace(well, '^([A-Za-z]+)0+', '\\1') AS well FROM (SELECT c_custkey, chr((65 + c_nationkey)::INTEGER) || lpad((c_custkey % 24 + 1)::VARCHAR, 3, '0') AS well FROM customer)")
def well_style(t):
    w = F.concat(F.char(F.lit(65) + F.col("c_nationkey")), F.lpad((F.col("c_custkey") % 24 + 1).cast("string"), 3, "0"))
    return t.customer.select("c_custkey", strings.well_style(w).alias("well"))


@query("""WITH g AS (SELECT 'sheet' || (p_size % 3) AS sheet, (p_partkey % 96) // 12 + 1 AS r, p_partkey % 12 + 1 AS c, min(p_name) AS v FROM part GROUP BY 1, 2, 3)
SELECT chr((64 + r)::INTEGER) || c AS well, max(v) FILTER (sheet = 'sheet0') AS m_sheet0, max(v) FILTER (sheet = 'sheet1') AS m_sheet1, max(v) FILTER (sheet = 'sheet2') AS m_sheet2 FROM g GROUP BY 1""")
def plate_layout(t):
    k = F.col("p_partkey")
    g = t.part.groupBy(F.concat(F.lit("sheet"), F.col("p_size") % 3).alias("sheet"), (F.floor(k % 96 / 12) + 1).cast("int").alias("row"), (k % 12 + 1).cast("int").alias("col")).agg(F.min("p_name").alias("value"))
    return plates.plate_layout(g, "wide", "m_", ["sheet0", "sheet1", "sheet2"])


URL = "regexp_extract(url, '([^/\\\\]+)[/\\\\]*$', 1)"


@query(f"SELECT page_id, {URL} AS base, regexp_extract(url, '^(.*)[/\\\\][^/\\\\]+[/\\\\]*$', 1) AS dir FROM pages")
def path_parts(t):
    u = F.col("url")
    return t.pages.select("page_id", strings.basename(u).alias("base"), strings.dirname(u).alias("dir"))


FILES = "f AS (SELECT 'd/' || p_brand || '_' || (p_size % 4) || '_ch' || (p_partkey % 3) || CASE WHEN p_partkey % 11 = 0 THEN '_mask.png' WHEN p_partkey % 13 = 0 THEN '.txt' ELSE '.tif' END AS path, p_partkey FROM part)"


def _files(t):
    k = F.col("p_partkey")
    end = F.when(k % 11 == 0, "_mask.png").when(k % 13 == 0, ".txt").otherwise(".tif")
    return t.part.select(F.concat(F.lit("d/"), "p_brand", F.lit("_"), F.col("p_size") % 4, F.lit("_ch"), k % 3, end).alias("path"), "p_partkey")


@query(f"WITH {FILES} SELECT p_partkey, CASE WHEN path LIKE '%_mask.png' THEN 'mask' ELSE 'intensity' END AS type, regexp_extract(path, 'd/([^_./]+)_([^_./]+)_ch([0-9]+)', 1) AS plate, regexp_extract(path, 'd/([^_./]+)_([^_./]+)_ch([0-9]+)', 2) AS well, regexp_extract(path, 'd/([^_./]+)_([^_./]+)_ch([0-9]+)', 3) AS channel, regexp_extract(path, 'd/([^_./]+)_([^_./]+)_ch([0-9]+)', 3)::INTEGER AS channel_n FROM f WHERE path NOT LIKE '%.txt'")
def filename_template(t):
    out = K.parse_files(_files(t), "{plate}_{well}_ch{channel}.tif", "{plate}_{well}_ch{channel}_mask.png")
    return out.select("p_partkey", "type", "plate", "well", "channel", "channel_n")


@query(f"WITH {FILES}, g AS (SELECT regexp_extract(path, 'd/([^_./]+)_', 1) AS plate, path LIKE '%_mask.png' AS mask FROM f WHERE path NOT LIKE '%.txt') SELECT plate, count(*) FILTER (NOT mask) AS n_intensity, count(*) FILTER (mask) AS n_mask FROM g GROUP BY 1")
def image_groups(t):
    out = K.parse_files(_files(t), "{plate}_{well}_ch{channel}.tif", "{plate}_{well}_ch{channel}_mask.png")
    return K.image_groups(out, ["plate"]).select("plate", F.size("intensities").cast("long").alias("n_intensity"), F.size("masks").cast("long").alias("n_mask"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_props(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT c_custkey, CASE WHEN abs(c_acctbal) < 100 THEN 'e' ELSE printf('%.2f', c_acctbal) END AS txt, split_part(c_name, '#', 1) AS base FROM customer")
def text_formats(t):
    x = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.when(F.abs(x) < 100, "e").otherwise(strings.format_auto(x, 0.01)).alias("txt"), F.split("c_name", "#")[0].alias("base"))


# --- Vectors ----------------------------------------------------------------------------------------------------------

EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query(f"WITH {EMB}, q AS (SELECT vec_id AS rep, v AS q FROM e WHERE vec_id % 50 = 0), s AS (SELECT e.vec_id, rep, list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)) AS s FROM e, q) SELECT vec_id, arg_max(rep, s) AS cluster, max(s) AS similarity FROM s GROUP BY 1", ["similarity"])
def embedding_nearest(t):
    """Nearest of a stated set of representatives, by cosine."""
    v = F.col("embedding").cast("array<double>")
    reps = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("rep"), v.alias("rep_fp"))
    return H.nearest_representative(t.embeddings.select("vec_id", v.alias("fp")), reps, "vec_id", similarity=maths.cosine("fp", "rep_fp"))


@query(f"WITH {EMB}, b AS (SELECT vec_id, list_transform(v, lambda x: (x > 0)::INTEGER) AS b FROM e), q AS (SELECT b AS q FROM b WHERE vec_id = 0), s AS (SELECT vec_id, list_sum([(b[i] * q[i]) FOR i IN range(1, 65)]) / list_sum([greatest(b[i], q[i]) FOR i IN range(1, 65)]) AS similarity FROM b, q) SELECT vec_id, similarity FROM s ORDER BY similarity DESC, vec_id LIMIT 20", ["similarity"])
def tanimoto_topn(t):
    bits = t.embeddings.select("vec_id", maths.sign_bits("embedding").alias("fp"))
    query_bits = bits.where("vec_id = 0").first()["fp"]
    return H.search_similar(bits, query_bits, 20, "vec_id").select("vec_id", "similarity")


@query(f"WITH {EMB}, u AS (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS i FROM e) SELECT label, list(m ORDER BY i)[1] AS first, list(m ORDER BY i)[64] AS last FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2) GROUP BY 1", ["first", "last"])
def mean_pool(t):
    out = H.mean_pool(t.embeddings.select("label", F.col("embedding").cast("array<double>").alias("v")), ["label"], "v")
    return out.select("label", F.col("v")[0].alias("first"), F.col("v")[63].alias("last"))


@query(f"WITH {EMB} SELECT label, sqrt(var_pop(v[1]) + var_pop(v[2]) + var_pop(v[3])) AS rmsf FROM e GROUP BY 1", ["rmsf"])
def rmsf(t):
    v = F.col("embedding")
    return H.rmsf(t.embeddings.select("label", *[v[i].cast("double").alias(a) for i, a in enumerate("xyz")]), ["label"])


# --- Events -----------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS \"start\", event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2", ["total"])
def event_windows(t):
    return incremental.windowed_counts(t.events)


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, k""", ["total"])
def event_sessions(t):
    return incremental.sessions(t.events)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def incremental_todo(t):
    return incremental.not_done(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])
