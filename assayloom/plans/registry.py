"""Registered queries over the driver tables, each beside its DuckDB counterpart where SQL can express it.

Doubles named in ``floats`` are rounded to six places on both sides, as sums in another order differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


class Tables:
    """The driver tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(sql: str | None = None, floats: tuple[str, ...] | list[str] = (), name: str | None = None):
    """Register a function of the tables under its name, with its SQL."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir)).withColumns({c: F.round(F.col(c), DIGITS) + F.lit(0.0) for c in floats})

        run.__doc__ = f.__doc__
        QUERIES[key] = run
        if sql:
            rounded = ", ".join(f'round("{c}", {DIGITS}) + 0::DOUBLE AS "{c}"' for c in floats)
            ORACLE[key] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if floats else sql
        return f

    return register


from assayloom.plans import biology, files, layouts, measures, numeric, relational, sequences, tables  # noqa: E402, F401
