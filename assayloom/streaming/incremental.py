"""Incremental work: skip what is done, and windows over event streams with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def not_done(todo: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Samples that the statistics table doesn't have yet."""
    return todo.join(done, on, "left_anti")


def available_now(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform=lambda df: df) -> StreamingQuery:
    """Process the files that have arrived since the last run, once each, then stop: an idempotent incremental batch."""
    stream = spark.readStream.schema(schema).parquet(source)
    return transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", by: list[str] | None = None, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by time window; streams drop what is later than the watermark."""
    by = by or ["event_type"]
    x = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return x.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    x = events.withWatermark(ts, late) if events.isStreaming else events
    return x.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def first_within(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events without repeats of their keys within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
