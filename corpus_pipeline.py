"""A corpus pipeline of five stages: language ID, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes every stage's result as
Parquet in the shared folder and reads it again. All stages but the last return the columns of ``documents``. Stages that
drop rows by a decision number them first, so that decisions take effect on rows without an id and on repeated ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm import decontaminate, language, neardup, packing, pii, tokens
from assayloom.session import bound_batches, materialize, table

#: Posterior below which the language of a text of so many words is taken as unknown; fewer words may leave it open.
LEAST_LANGUAGE_SCORE, LEAST_WORDS = 0.5, 4
#: Keys of dropped rows that are broadcast; more are shuffled.
BROADCAST_KEYS = 1_000_000
#: Pieces of text that a packing task remembers: fewer than where packing runs alone, and only while the task lasts.
REMEMBERED = 300_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(of: Stage) -> Stage:
    """The stage with Arrow batches of a bounded size, as it sends whole texts to Python."""

    @wraps(of)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return of(spark, docs, sf_dir)

    return run


def fresh(name: str, docs: DataFrame) -> str:
    """A name that no column of the documents has."""
    while name in docs.columns:
        name += "_"
    return name


def keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The stage's input with a running number for each row, written once, so that every later reading has the same (ids
    may be missing or repeat), and that column's name."""
    row = fresh("_row", docs)
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), f"{name}-rows"), row


def without(rows: DataFrame, keys: DataFrame, row: str) -> DataFrame:
    """Rows whose key isn't among ``keys`` (a written table); broadcast up to a counted bound, else shuffled."""
    keys = keys.distinct()
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return rows.join(keys, row, "left_anti").drop(row)


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null, empty and letterless texts, and texts of some words whose
    posterior is below the bound. A missing ``lang`` becomes the predicted one. Where nothing is labelled there is no
    model, and all texts with a letter stay. Repeated rows are treated alike; all columns stay as they are."""
    columns, model = docs.columns, language.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh("_lang", docs), fresh("_score", docs)
    found = language.predict(docs.select("text", *columns), model, own=True, names=(lang, score))
    short = F.size(F.split(F.trim("text"), r"\s+", LEAST_WORDS)) < LEAST_WORDS
    kept = found.where((F.col(lang) != language.UNKNOWN) & ((F.col(score) >= LEAST_LANGUAGE_SCORE) | short))
    return kept.select(*[F.coalesce("lang", lang).alias("lang") if c == "lang" else F.col(c) for c in columns])


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least id stays (of several such, the first; one without an id
    only if none has one). Rows count one by one, whatever their ids. Null and empty texts are no one's copies."""
    rows, row = keyed(docs, "near_duplicates")
    groups = materialize(neardup.near_duplicates(rows, row).select(row, F.col("component_id").alias("_group")), "groups")
    ids = rows.select(row, F.col("doc_id").alias("_id"))
    first = groups.join(ids, row).groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", row)).alias("_least"))
    dropped = groups.join(first.select(F.col(f"_least.{row}").alias(row)), row, "left_anti").select(row)
    return without(rows, materialize(dropped, "duplicates"), row).select(docs.columns)


@stage
def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak a benchmark item go, each row by its own text; null and empty texts leak nothing."""
    rows, row = keyed(docs, "decontaminate")
    leaks = decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark"), id_col=row)
    return without(rows, materialize(leaks.select(F.col("doc_id").alias(row)), "leaks"), row).select(docs.columns)


@stage
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text (null for a null text). All rows stay."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens; a null or empty text is the end id alone."""
    return packing.pack_documents(docs, tokens.vocabulary("byte_bpe_50k.json"), "space", remembered=REMEMBERED, keep=False)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the classifiers, nor the packing; the tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = materialize(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
