"""Table functions: one value in, rows out. They work in SQL after ``register``, and with literals from Python."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="pos int, kmer string")
class Kmers:
    """Place (from 1) and letters of every window of k letters of a sequence; none for null or shorter ones."""

    def eval(self, seq: str, k: int) -> Iterator[tuple[int, str]]:
        if seq is not None and k is not None and k > 0:
            for i in range(len(seq) - k + 1):
                yield i + 1, seq[i : i + k]


@udtf(returnType="row int, col int, well string")
class PlateWells:
    """Wells of a plate of so many rows and columns, row by row."""

    def eval(self, rows: int, cols: int) -> Iterator[tuple[int, int, str]]:
        for i in range((rows or 0) * (cols or 0)):
            r, c = divmod(i, cols)
            yield r + 1, c + 1, ("" if r < 26 else chr(64 + r // 26)) + chr(65 + r % 26) + str(c + 1)


def register(spark: SparkSession) -> None:
    """``kmers(seq, k)`` and ``plate_wells(rows, cols)`` in SQL, laterally too."""
    spark.udtf.register("kmers", Kmers)
    spark.udtf.register("plate_wells", PlateWells)
