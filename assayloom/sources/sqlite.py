"""SQLite databases of per-object tables: a Python data source, and the usual clean-up of its columns."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from assayloom.operators.columns import average_directions, remove_constant, select_roles, strip_prefix

_TYPES = (("INT", "bigint"), ("CHAR", "string"), ("TEXT", "string"), ("CLOB", "string"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BLOB", "binary"))


def columns_of(path: str, table: str) -> list[tuple[str, str]]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return [(r[1], next((t for k, t in _TYPES if k in r[2].upper()), "double")) for r in con.execute(f'PRAGMA table_info("{table}")')]


def tables_of(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, parts: int) -> None:
        self.path, self.table, self.names, self.parts = path, table, schema.names, parts

    def partitions(self) -> list[Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)] or [Range(0, -1)]

    def read(self, partition: Range) -> Iterator[tuple]:
        listed = ", ".join(f'"{n}"' for n in self.names)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            yield from con.execute(f'SELECT {listed} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """format("sqlite_table") with options path, table, parts; parts are ranges of row ids. The file must be readable on
    every executor (a shared mount)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in columns_of(self.options["path"], self.options["table"]))

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("parts", "8")))


def read_table(spark: SparkSession, path: str, table: str, parts: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").options(path=path, table=table, parts=str(parts)).load()


def read_all(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Every table by name, without constant columns."""
    return {t: remove_constant(read_table(spark, path, t)) for t in tables_of(path) if t not in skip}


def read_objects(spark: SparkSession, path: str, table: str, drop: list[str] | None = None, prefix: str = "", scale: float = 65535.0, classes: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """A per-object table: columns pruned by pattern, intensities times 65535 and rounded, the object's prefix stripped,
    texture directions averaged, a class table joined."""
    df = select_roles(read_table(spark, path, table), drop=drop)
    rescale = {c: F.bround(F.col(c) * scale, 0) for c in df.columns if re.search("Intensity_(Mean|Median|Min|Max|Integrated|Std|Lower|Upper)", c)}
    df = average_directions(strip_prefix(df.withColumns(rescale), prefix))
    return df.join(classes, key, "left") if classes is not None else df
