"""Ordered operators: ratios to controls, outliers, cumulative curves, ranks, serpentine orders, chunks.

Ranks and running sums of large groups work on two levels (``running``): a group is cut into buckets along its order, the
buckets' totals are summed up over the few buckets, and each bucket is sorted on its own, so no group lands in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.maths import probit
from assayloom.functions.nulls import clean, ratio
from assayloom.operators.relational import null_safe_join


#: Buckets that a group is cut into, at approximate quantiles of its order.
BUCKETS = 64
_OPS = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, by: list[str], bucket: Column, order: list[Column], out: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """Add running values within groups: name -> (sum, max or min, value, whether the row itself counts). ``bucket`` must
    not fall along the order. A sum of nothing is 0, a maximum or minimum of nothing null."""
    keys = [*by, "_bucket"]
    x = df.withColumn("_bucket", bucket)
    parts = x.groupBy(*keys).agg(*[_OPS[op](v).alias(f"_p{i}") for i, (op, v, _) in enumerate(out.values())])
    before = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, *[_OPS[op](f"_p{i}").over(before).alias(f"_q{i}") for i, (op, _, _) in enumerate(out.values())])
    j = null_safe_join(x, parts, keys)
    inside = Window.partitionBy(*keys).orderBy(*order)
    for i, (name, (op, value, own)) in enumerate(out.items()):
        here = _OPS[op](value).over(inside.rowsBetween(Window.unboundedPreceding, 0 if own else -1))
        both = F.coalesce(F.col(f"_q{i}"), F.lit(0)) + F.coalesce(here, F.lit(0)) if op == "sum" else (F.greatest if op == "max" else F.least)(F.col(f"_q{i}"), here)
        j = j.withColumn(name, both)
    return j.drop("_bucket", *[f"_q{i}" for i in range(len(out))])


def along(df: DataFrame, by: list[str], x: Column, descending: bool = False) -> tuple[DataFrame, Column]:
    """The table with the cuts of each group along a number, and the bucket of a row (nulls first, or last if falling)."""
    value = x.cast("double")
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, F.lit([i / BUCKETS for i in range(1, BUCKETS)]), F.lit(1000)).alias("_cuts"))
    out = null_safe_join(df.withColumn("_along", value), cuts, by) if by else df.withColumn("_along", value).crossJoin(F.broadcast(cuts))  # one row
    bucket = F.when(F.col("_along").isNull(), -1).otherwise(F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col("_along"))))
    return out, -bucket if descending else bucket


def ranked(df: DataFrame, by: list[str], x: Column, tie: list[Column] = (), descending: bool = False, out: str = "_k") -> DataFrame:
    """Add the running number from 1 of each row in its group by a number, then ``tie``."""
    cut, bucket = along(df, by, x, descending)
    order = [F.col("_along").desc() if descending else F.col("_along"), *tie]
    return running(cut, by, bucket, order, {out: ("sum", F.lit(1).cast("long"), True)}).drop("_cuts", "_along")


def group_quantiles(df: DataFrame, by: list[str], x: Column, probs: list[float], names: list[str]) -> DataFrame:
    """Exact interpolated quantiles by group, from the values at the ranks around each; NaN and null are left out."""
    v = df.select(*by, clean(x).alias("_x")).where("_x IS NOT NULL")
    n = v.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    r = ranked(v, by, F.col("_x"))
    r = null_safe_join(r, n, by) if by else r.crossJoin(F.broadcast(n))  # one row
    aggs = []
    for p, name in zip(probs, names, strict=True):
        at = (F.col("_n") - 1) * F.lit(float(p)) + 1
        low, high = (F.max(F.when(F.col("_k") == f(at), F.col("_x"))) for f in (F.floor, F.ceil))
        share = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * share).alias(name))
    return r.groupBy(*by).agg(*aggs)


def tied_ranks(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    """Rank with the mean for ties of the distinct values of each group: by, _x, _rank, _n (rows of the group)."""
    v = df.select(*by, x.alias("_x")).groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    cut, bucket = along(v, by, F.col("_x"))
    r = running(cut, by, bucket, [F.col("_x")], {"_before": ("sum", F.col("_c"), False)}).drop("_cuts", "_along")
    n = v.groupBy(*by).agg(F.sum("_c").alias("_n"))
    r = null_safe_join(r, n, by) if by else r.crossJoin(F.broadcast(n))  # one row
    return r.withColumn("_rank", F.col("_before") + (F.col("_c") + 1) / F.lit(2.0)).drop("_before", "_c")


def average_rank(by: list[str], order: Column) -> Column:
    """Rank with the mean for ties."""
    w = Window.partitionBy(*by)
    ties = Window.partitionBy(*by, order)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def label_ends(df: DataFrame, by: list[str], score: str, n: int = 100) -> DataFrame:
    """Average rank by group; the first n by rank are 'neg' (lowest), the last n 'pos'."""
    out = df.withColumn("rank", average_rank(by, F.col(score))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return out.withColumn("label", F.when(F.col("rank") <= n, "neg").when(F.col("rank") > F.col("_n") - n, "pos").otherwise("ns")).drop("_n")


def control_ratio(df: DataFrame, by: list[str], x: str, is_control: Column, out: str = "ratio", how=F.avg) -> DataFrame:
    """x over the mean of the control rows of its partition."""
    return df.withColumn(out, ratio(F.col(x), how(F.when(is_control, clean(x))).over(Window.partitionBy(*by))))


def lowest_dose_ratio(df: DataFrame, by: list[str], x: str, dose: str, out: str = "ratio") -> DataFrame:
    w = Window.partitionBy(*by)
    low = df.withColumn("_low", F.min(dose).over(w))
    return low.withColumn(out, ratio(F.col(x), F.avg(F.when(F.col(dose) == F.col("_low"), clean(x))).over(w))).drop("_low")


def remove_outliers(df: DataFrame, by: list[str], cols: list[str], coef: float = 1.5) -> DataFrame:
    """Rows without a value beyond the quartiles by more than coef times their distance; null isn't an outlier."""
    q = df
    for i, c in enumerate(cols):
        found = group_quantiles(df, by, F.col(c), [0.25, 0.75], [f"_a{i}", f"_b{i}"])
        q = null_safe_join(q, found, by) if by else q.crossJoin(F.broadcast(found))  # one row
    tests = []
    for i, c in enumerate(cols):
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        tests.append(F.coalesce((clean(c) < a - coef * (b - a)) | (clean(c) > b + coef * (b - a)), F.lit(False)))
    return q.where(~reduce(lambda p, q: p | q, tests)).select(df.columns)


def cdf(df: DataFrame, by: list[str], order: list[str], weight: str, out: str = "cdf") -> DataFrame:
    """Share of the group's weight up to each row, by a number and then the other columns of the order."""
    cut, bucket = along(df, by, F.col(order[0]))
    x = running(cut, by, bucket, [F.col(c) for c in order], {"_upto": ("sum", F.col(weight), True)}).drop("_cuts", "_along")
    total = df.groupBy(*by).agg(F.sum(weight).alias("_total"))
    x = null_safe_join(x, total, by) if by else x.crossJoin(F.broadcast(total))  # one row
    return x.withColumn(out, ratio(F.col("_upto"), F.col("_total"))).drop("_upto", "_total")


def lorenz(df: DataFrame, by: list[str], x: str, tie: list[str]) -> DataFrame:
    """Share of rows and cumulative share of the total, highest first."""
    cut, bucket = along(df, by, F.col(x), descending=True)
    upto = {"_k": ("sum", F.lit(1).cast("long"), True), "_upto": ("sum", F.col(x), True)}
    r = running(cut, by, bucket, [F.col(x).desc(), *map(F.col, tie)], upto).drop("_cuts", "_along")
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(x).alias("_total"))
    r = null_safe_join(r, total, by) if by else r.crossJoin(F.broadcast(total))  # one row
    return r.withColumns({"share_rows": F.col("_k") / F.col("_n").cast("double"), "share_total": ratio(F.col("_upto"), F.col("_total"))}).drop("_k", "_upto", "_n", "_total")


def binned_cdf(df: DataFrame, by: list[str], x: str, width: float) -> DataFrame:
    """Counts of bins closed on the left, with cumulative shares."""
    bins = df.withColumn("bin", F.floor(F.col(x) / width).cast("long")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return cdf(bins, by, ["bin"], "n")


def every_kth(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """Rows 1, k + 1, 2k + 1 of each group, by a number or time and then the other columns of the order."""
    first = F.col(order[0])
    number = first if not df.schema[order[0]].dataType.simpleString().startswith("timestamp") else F.unix_micros(first.cast("timestamp"))
    return ranked(df, by, number, [F.col(c) for c in order]).where((F.col("_k") - 1) % k == 0).drop("_k")


def zscore(df: DataFrame, by: list[str], x: str, out: str = "z") -> DataFrame:
    """(x - mean) / sd within row or column groups of the long form; null where sd is 0."""
    m = df.groupBy(*by).agg(F.avg(clean(x)).alias("_m"), F.stddev_samp(clean(x)).alias("_s"))
    j = null_safe_join(df, m, by) if by else df.crossJoin(F.broadcast(m))  # one row
    return j.withColumn(out, ratio(clean(x) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def serpentine(df: DataFrame, row: str, col: str, by: str = "lr", out: str = "visit", within: list[str] | None = None) -> DataFrame:
    """Visiting order of a grid that turns at each row (lr, ll) or column (tb, tt): the second letter repeats the first
    where every line runs the same way."""
    major, minor = (row, col) if by[0] == "l" else (col, row)
    w = Window.partitionBy(*(within or [F.lit(1)]))
    turned = df.withColumn("_line", F.dense_rank().over(w.orderBy(major)))
    sign = F.when((F.col("_line") % 2 == 0) & F.lit(by[0] != by[1] and by not in ("ll", "tt")), -1).otherwise(1)
    return turned.withColumn(out, F.row_number().over(w.orderBy(major, F.col(minor) * sign))).drop("_line")


def snake_fields(df: DataFrame, within: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Order of the fields of a well: columns left to right, up and down in turn."""
    w = Window.partitionBy(*within)
    col = df.withColumn("_c", F.dense_rank().over(w.orderBy(x)))
    return col.withColumn("visit", F.row_number().over(w.orderBy("_c", F.when(F.col("_c") % 2 == 1, -F.col(y)).otherwise(F.col(y))))).drop("_c")


def inverse_normal(df: DataFrame, x: str, by: list[str] | None = None, out: str = "int") -> DataFrame:
    """Normal quantile of (average rank - 0.5) / n."""
    by = by or []
    r = tied_ranks(df, by, F.col(x)).withColumnRenamed("_x", x)
    return null_safe_join(df, r, [*by, x]).withColumn(out, probit((F.col("_rank") - 0.5) / F.col("_n"))).drop("_rank", "_n")


def to_plates(df: DataFrame, order: list[str], capacity: int = 96, within: list[str] | None = None) -> DataFrame:
    """plate_number and position 1..capacity by order; a single number is ranked on two levels, other orders, as of labels,
    in one task for each group."""
    simple = len(order) == 1 and df.schema[order[0]].dataType.simpleString() in ("int", "bigint", "double", "float", "smallint")
    if simple:
        numbered = ranked(df, within or [], F.col(order[0])).withColumn("_k", F.col("_k") - 1)
    else:
        numbered = df.withColumn("_k", F.row_number().over(Window.partitionBy(*(within or [F.lit(1)])).orderBy(*order)) - 1)
    return numbered.withColumns({"plate_number": (F.floor(F.col("_k") / capacity) + 1).cast("int"), "position": (F.col("_k") % capacity + 1).cast("int")}).drop("_k")
