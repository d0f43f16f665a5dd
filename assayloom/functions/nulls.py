"""Missing values as the analyses mean them: NaN is missing, division by zero and logs of non-positive values give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column | str) -> Column:
    """A double with NaN as null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def safe_log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """Bounded x; null stays null."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def range_flag(x: Column, low: float, high: float) -> Column:
    """'in' or 'out' of the bounds."""
    return F.when(x.isNotNull(), F.when((x < low) | (x > high), "out").otherwise("in"))


def number(x: Column | str) -> Column:
    """Text to double; null if it isn't a number."""
    return (F.col(x) if isinstance(x, str) else x).try_cast("double")
