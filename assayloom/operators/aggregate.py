"""Group summaries: trimmed means, standard errors, field and well summaries, coverage and quality figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.nulls import clean, ratio
from assayloom.operators.relational import null_safe_join
from assayloom.operators.windows import group_quantiles, ranked


def trimmed_mean_agg(x: str, trim: float) -> Column:
    """Mean without floor(n * trim) values at either end, as an aggregate; holds a group's values in memory, so for groups
    of moderate size. Nulls and NaNs are left out."""
    s = f"array_sort(collect_list(nanvl(CAST({x} AS DOUBLE), NULL)))"
    k = f"CAST(floor(size({s}) * {trim}D) AS INT)"
    return F.expr(f"aggregate(slice({s}, {k} + 1, greatest(size({s}) - 2 * {k}, 0)), 0D, (a, v) -> a + v) / nullif(size({s}) - 2 * {k}, 0)")


def trimmed_mean(df: DataFrame, by: list[str], cols: list[str], trim: float, tie: list[str] | None = None) -> DataFrame:
    """The same by ranks on two levels, so a group may be as large as it likes."""
    out = None
    for c in cols:
        x = df.select(*by, clean(c).alias(c), *(tie or [])).where(F.col(c).isNotNull())
        n = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        x = null_safe_join(ranked(x, by, F.col(c), [F.col(k) for k in tie or []]), n, by)
        drop = F.floor(F.col("_n") * F.lit(float(trim)))
        one = x.where((F.col("_k") > drop) & (F.col("_k") <= F.col("_n") - drop)).groupBy(*by).agg(F.avg(c).alias(c))
        out = one if out is None else null_safe_join(out, one, by, "outer")
    return out


def se(x: Column, variant: str = "n") -> Column:
    """Standard error: sd / sqrt(n) of the non-null values, or sd / sqrt(length - 1)."""
    n = F.count(x) if variant == "n" else F.count(F.lit(1)) - 1
    return F.stddev_samp(x) / F.sqrt(F.nullif(n.cast("double"), F.lit(0.0)))


def summarize_field(df: DataFrame, by: list[str], mean_keys: list[str], sum_keys: list[str], mean_func: Callable[[str], Column] | None = None, sum_func: Callable[[str], Column] | None = None, trim: float = 0.0) -> DataFrame:
    """Cells to fields: means (trimmed if asked) and sums of the columns that exist, and the number of cells, in one aggregation."""
    by = [c for c in by if c in df.columns]
    mean = mean_func or ((lambda c: trimmed_mean_agg(c, trim)) if trim else (lambda c: F.avg(clean(c))))
    total = sum_func or (lambda c: F.sum(clean(c)))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("cell_count"), *[mean(c).alias(c) for c in mean_keys if c in df.columns], *[total(c).alias(c) for c in sum_keys if c in df.columns])


def mean_sd(df: DataFrame, by: list[str], cols: list[str], trim: float = 0.0, digits: int | None = None) -> DataFrame:
    """<col>_mean (trimmed if asked), <col>_sd and <col>_se, rounded to so many digits."""
    aggs = []
    for c in cols:
        x = clean(c)
        aggs += [(trimmed_mean_agg(c, trim) if trim else F.avg(x)).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_sd"), se(x).alias(f"{c}_se")]
    out = df.groupBy(*by).agg(*aggs)
    return out if digits is None else out.withColumns({c: F.round(F.col(c), digits) for c in out.columns if c not in by})


def quantiles(df: DataFrame, by: list[str], x: str, probs: list[float], approximate: bool = False) -> DataFrame:
    """Interpolated quantiles, a column each (q05, q50, ..); approximate ones for very large groups."""
    f = F.percentile_approx if approximate else F.percentile
    return df.groupBy(*by).agg(*[f(clean(x), F.lit(p)).alias(f"q{round(p * 100):02d}") for p in probs])


def quantile_trimmed_sum(df: DataFrame, by: list[str], x: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Sum of the values strictly between two quantiles of their group."""
    q = null_safe_join(df.select(*by, clean(x).alias("_x")), group_quantiles(df, by, F.col(x), [low, high], ["_a", "_b"]), by)
    return q.groupBy(*by).agg(F.sum(F.when((F.col("_x") > F.col("_a")) & (F.col("_x") < F.col("_b")), F.col("_x"))).alias(x))


def nested_counts(df: DataFrame, inner: list[str], mid: list[str], outer: list[str]) -> DataFrame:
    """Distinct entities, how many per mid level, and how many mid levels and entities per outer level."""
    per_mid = df.select(*inner).distinct().groupBy(*mid).agg(F.count(F.lit(1)).alias("n_inner"))
    return per_mid.groupBy(*outer).agg(F.count(F.lit(1)).alias("n_mid"), F.sum("n_inner").alias("n_inner"))


def joined_text(x: str, sep: str = ";") -> Column:
    """Distinct non-null values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(x)), sep)


def span(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    return df.groupBy(*by).agg(F.min(start).alias(start), F.max(end).alias(end))


def spot_fraction(cells: DataFrame, spots: DataFrame, by: list[str], cell_value: str, spot_value: str) -> DataFrame:
    """Spots' total per cell as a share of the cell's own (0 without spots); cells with a share of 1 or more go."""
    total = spots.groupBy(*by).agg(F.sum(clean(spot_value)).alias("spot_total"))
    out = cells.join(total, by, "left").withColumn("spot_total", F.coalesce("spot_total", F.lit(0.0)))
    out = out.withColumn("spot_fraction", F.coalesce(ratio(F.col("spot_total"), F.col(cell_value)), F.lit(0.0)))
    return out.where("spot_fraction < 1")


def sum_by_gene(df: DataFrame, gene: str, cols: list[str], least: float) -> DataFrame:
    """Sums per gene; genes whose sums don't exceed a total go."""
    out = df.groupBy(gene).agg(*[F.sum(c).alias(c) for c in cols])
    return out.where(sum((F.coalesce(F.col(c), F.lit(0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0))) > least)


def binarise(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Sum duplicates, then 1 where the sum is positive."""
    return df.groupBy(key).agg(*[(F.sum(c) > 0).cast("int").alias(c) for c in cols])


def group_sizes(df: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """Mean, least and largest number of members of the groups."""
    n = df.groupBy(*by, *group).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), F.avg("_n").alias("mean_members"), F.min("_n").alias("min_members"), F.max("_n").alias("max_members"))


def gini(df: DataFrame, by: list[str], x: str, tie: list[str]) -> DataFrame:
    """Gini index of counts, share of zeros, total; by ranks on two levels."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    r = null_safe_join(ranked(df, by, F.col(x), [F.col(k) for k in tie]), n, by)
    top = F.sum((2 * F.col("_k") - F.col("_n") - 1) * F.col(x).cast("double"))
    return r.groupBy(*by).agg(ratio(top, F.max("_n") * F.sum(x)).alias("gini"), (100.0 * F.avg((F.col(x) == 0).cast("double"))).alias("zero_pct"), F.sum(x).alias("total"))


def peak_reads(df: DataFrame, reads: str = "reads", frip: str = "frip") -> DataFrame:
    """Reads inside and outside peaks."""
    inside = F.bround(F.col(reads) * F.col(frip)).cast("long")
    return df.withColumns({"peak_reads": inside, "out_reads": F.col(reads) - inside})
