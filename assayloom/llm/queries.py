"""The registered queries of this subpackage: one thin ``opN_<name>`` per operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm import decontaminate, language, media, neardup, packing, pii, secrets, sharding, store, tokens, toxicity
from assayloom.session import bound_batches, scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]


def bounded(query: Query) -> Query:
    """The query with Arrow batches of a bounded size, as it sends whole texts to Python."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position",
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out_expr().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, c -> c.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op4_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    store.write_store(table(spark, sf_dir, "documents"), path, tokens.vocabulary("word_bpe_49k.json"), "drop")
    return store.read_digests(spark, path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), "space")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), secrets.fit(secrets.labelled_findings()))
    counts = [F.expr(f"CAST(size(filter(found, c -> c.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}") for kind in secrets.BASE]
    base = f"filter(found, c -> c.kind IN ({', '.join(repr(k) for k in secrets.BASE)}))"
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed("found").alias("spans"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.drop("lang"), language.train(docs))
    return found.select("doc_id", language.held_out_expr().alias("held_out"), "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_features(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: bounded(f) for f in (op1_sharding, op2_toxicity, op3_pii, op4_store, op5_packing, op6_secrets, op7_neardup, op8_language, op9_decontaminate, op10_media)
}

# Written apart from the query: keys, rounds and walk as recursive tables, a row for each round of each row number.
OP1_SQL = """
WITH RECURSIVE bits AS (SELECT range AS v, 0 AS k, range AS c FROM range(256)
  UNION ALL SELECT v, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
sized AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
keyed AS (SELECT doc_id, length(h) // 2 + 1 AS size,
    xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1),
      lambda s, x: xor(t[xor(s & 255, x) + 1], s >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM sized, crc),
mixed AS (SELECT *, ((coalesce(doc_id, 0) % 2147483647 + 2147483647) % 2147483647 * 48271 + size % 2147483647 * 69621 + text_crc32) % 2147483647 AS m FROM keyed),
numbered AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY m * 16807 % 2147483647 % 4096, doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number FROM mixed),
round_keys AS (SELECT 0 AS i, 21::BIGINT * 48271 % 2147483647 AS key UNION ALL SELECT i + 1, key * 48271 % 2147483647 FROM round_keys WHERE i < 5),
sides AS (SELECT count(*) AS total, ceil(sqrt(count(*)::DOUBLE))::BIGINT AS a FROM documents),
walk AS (SELECT row_number, 0 AS i, row_number % a AS l, row_number // a AS r, total, a, (total + a - 1) // a AS b FROM numbered, sides
  UNION ALL SELECT row_number, i + 1, CASE WHEN i % 2 = 0 THEN (l + f) % a ELSE l END, CASE WHEN i % 2 = 1 THEN (r + f) % b ELSE r END, total, a, b
  FROM (SELECT *, (g + g // 32768 * 7919 + 12345) % 2147483647 * 69621 % 2147483647 AS f
    FROM (SELECT w.*, (CASE WHEN w.i % 2 = 0 THEN w.r ELSE w.l END + key) % 2147483647 * 48271 % 2147483647 AS g FROM walk w JOIN round_keys k ON k.i = w.i % 6
      WHERE w.i = 0 OR w.i % 6 <> 0 OR w.l + w.a * w.r >= w.total))),
done AS (SELECT row_number, l + a * r AS position FROM walk WHERE i > 0 AND i % 6 = 0 AND l + a * r < total)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position % 16)::INTEGER AS shard, position // 16 AS slot, NULL::INTEGER AS grown_shard, row_number, position
FROM numbered JOIN done USING (row_number)
"""

OP7_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c.b AS component_id, doc_id = c.b AS kept FROM sets JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) c ON c.a = doc_id
"""

ORACLE: dict[str, str] = {
    "op7_neardup": OP7_SQL,
    "op1_sharding": OP1_SQL,
}
