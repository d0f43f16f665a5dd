"""Normalisation, tests, correlation and dose response."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.maths import normal_two_sided, signif, t_pvalue
from assayloom.functions.nulls import clean, ratio, safe_log2
from assayloom.operators.aggregate import trimmed_mean_agg
from assayloom.operators.relational import null_safe_join
from assayloom.operators.windows import along, average_rank, ranked, running
from assayloom.session import materialize


def fold_change(df: DataFrame, by: list[str], cols: list[str], control: Column, use_median: bool = False, log: bool = False, trim: float = 0.0, const: float = 0.0, const_on: str = "denominator") -> DataFrame:
    """Each measure over its group's control: the (trimmed) mean of control rows, or the median of all rows of the group.

    ``const`` is added to the denominator, or to the ratio (``const_on="ratio"``). Groups match null to null; a group
    without control gives null. Adds <col>_FC or <col>_log2FC.
    """
    if const_on not in ("denominator", "ratio"):
        raise ValueError("const_on must be denominator or ratio")
    base = df if use_median else df.where(control)
    how = (lambda c: F.median(clean(c))) if use_median else (lambda c: trimmed_mean_agg(c, trim)) if trim else (lambda c: F.avg(clean(c)))
    middle = base.groupBy(*by).agg(*[how(c).alias(f"_ctrl_{c}") for c in cols])
    out = null_safe_join(df, middle, by)

    def fold(c: str) -> Column:
        r = ratio(clean(c), F.col(f"_ctrl_{c}") + const) if const_on == "denominator" else ratio(clean(c), F.col(f"_ctrl_{c}")) + const
        return safe_log2(r) if log else r

    return out.withColumns({f"{c}_{'log2FC' if log else 'FC'}": fold(c) for c in cols}).drop(*[f"_ctrl_{c}" for c in cols])


def control_median_ratio(df: DataFrame, by: list[str], x: str, control: Column, const: float = 0.0, log: bool = False) -> DataFrame:
    """value / (median of the control rows + const)."""
    middle = df.where(control).groupBy(*by).agg(F.median(clean(x)).alias("_ctrl"))
    r = ratio(clean(x), F.col("_ctrl") + const)
    return null_safe_join(df, middle, by).withColumn("value_ratio", safe_log2(r) if log else r).drop("_ctrl")


def shift_to_reference(df: DataFrame, by: list[str], x: str, reference: Column, out: str) -> DataFrame:
    """x minus the median of the reference rows of its group."""
    middle = df.where(reference).groupBy(*by).agg(F.median(clean(x)).alias("_ref"))
    return null_safe_join(df, middle, by).withColumn(out, clean(x) - F.col("_ref")).drop("_ref")


def welch(df: DataFrame, by: list[str], item: str, control: str, x: str, pvalue: bool = True) -> DataFrame:
    """Welch t test of every level of ``item`` against the control level of its group, from moments."""
    m = df.groupBy(*by, item).agg(F.count(clean(x)).alias("n"), F.avg(clean(x)).alias("m"), F.var_samp(clean(x)).alias("v"))
    c = m.where(F.col(item) == control).select(*by, F.col("n").alias("n0"), F.col("m").alias("m0"), F.col("v").alias("v0"))
    out = null_safe_join(m.where(F.col(item) != control), c, by)
    a, b = F.col("v") / F.col("n"), F.col("v0") / F.col("n0")
    out = out.withColumns({"t": ratio(F.col("m") - F.col("m0"), F.sqrt(a + b)), "df": ratio((a + b) * (a + b), ratio(a * a, F.col("n") - 1) + ratio(b * b, F.col("n0") - 1))})
    if pvalue:
        out = out.withColumn("pvalue", t_pvalue("t", "df"))
    return out.drop("n", "m", "v", "n0", "m0", "v0")


def level_pvalues(df: DataFrame, by: list[str], item: str, control: str, cols: list[str], use_median: bool = False, digits: int = 4) -> DataFrame:
    """Statistic and p of every level of ``item`` against the control level, for many measures: <col>_statistic and
    <col>_pvalue to so many significant digits, beside the level's mean (or median) in <col>. Null where a test fails."""
    middle = F.median if use_median else F.avg
    out = df.where(F.col(item) != control).groupBy(*by, item).agg(*[middle(clean(c)).alias(c) for c in cols])
    for c in cols:
        t = welch(df, by, item, control, c).select(*by, item, signif(F.col("t"), digits).alias(f"{c}_statistic"), signif(F.col("pvalue"), digits).alias(f"{c}_pvalue"))
        out = null_safe_join(out, t, [*by, item])
    return out


def enrich_fold(spots: DataFrame, rings: DataFrame, keys: list[str], cols: list[str], suffix: str = "_ring") -> DataFrame:
    """(spot + 1) / (ring + 1) of each measure, to three digits; the rings' columns go."""
    both = null_safe_join(spots, rings.withColumnsRenamed({c: c + suffix for c in cols}), keys)
    return both.withColumns({f"{c}_enrich": F.round(ratio(F.col(c) + 1, F.col(c + suffix) + 1), 3) for c in cols}).drop(*[c + suffix for c in cols])


def ks_two_sample(df: DataFrame, by: list[str], x: str, in_first: Column) -> DataFrame:
    """Largest gap between two empirical distributions by group, and its asymptotic p-value."""
    v = df.select(*by, clean(x).alias("_x"), in_first.alias("_f")).where("_x IS NOT NULL AND _f IS NOT NULL")
    g = v.groupBy(*by, "_x").agg(F.sum(F.col("_f").cast("int")).alias("_a"), F.sum((~F.col("_f")).cast("int")).alias("_b"))
    w = Window.partitionBy(*by)
    upto = w.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({"_ca": F.sum("_a").over(upto), "_cb": F.sum("_b").over(upto), "_na": F.sum("_a").over(w), "_nb": F.sum("_b").over(w)})
    gap = F.abs(ratio(F.col("_ca"), F.col("_na")) - ratio(F.col("_cb"), F.col("_nb")))
    out = g.groupBy(*by).agg(F.max(gap).alias("D"), F.max("_na").alias("n1"), F.max("_nb").alias("n2"))
    series = "aggregate(sequence(1, 100), 0D, (s, k) -> s + IF(k % 2 = 1, 2D, -2D) * exp(-2D * k * k * _l * _l))"
    out = out.withColumn("_l", F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")).cast("double")) * F.col("D"))
    return out.withColumn("pvalue", F.expr(f"IF(_l < 0.2D, 1D, least(1D, greatest(0D, {series})))")).drop("_l")


def rank_sum(df: DataFrame, by: list[str], x: str, in_first: Column, pvalue: bool = True) -> DataFrame:
    """Wilcoxon rank-sum: U of the first sample, z by the normal approximation with ties taken into account."""
    v = df.select(*by, clean(x).alias("_x"), in_first.alias("_f")).where("_x IS NOT NULL AND _f IS NOT NULL")
    r = v.withColumn("_r", average_rank(by or ["_one"], F.col("_x")) if by else average_rank([F.lit(1)], F.col("_x")))
    # A value's ties enter as t^3 - t: summed over its t rows, t^2 - 1 each.
    t = F.count(F.lit(1)).over(Window.partitionBy(*(by or [F.lit(1)]), "_x")).cast("double")
    g = r.withColumn("_t", t * t - 1).groupBy(*by).agg(F.sum(F.when(F.col("_f"), F.col("_r"))).alias("_s"), F.sum(F.col("_f").cast("int")).alias("n1"), F.sum((~F.col("_f")).cast("int")).alias("n2"), F.sum("_t").alias("_ties"))
    u = F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2.0
    n = (F.col("n1") + F.col("n2")).cast("double")
    z = ratio(u - F.col("n1") * F.col("n2") / 2.0, F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - ratio(F.col("_ties"), n * (n - 1)))))
    out = g.withColumns({"U": u, "z": z}).drop("_s", "_ties")
    return out.withColumn("pvalue", normal_two_sided("z")) if pvalue else out


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    v = df.where(clean(x).isNotNull() & clean(y).isNotNull())
    part = by or [F.lit(1)]
    r = v.withColumns({"_rx": average_rank(part, F.col(x)), "_ry": average_rank(part, F.col(y))})
    return r.groupBy(*by).agg(F.corr("_rx", "_ry").alias("spearman"))


def kendall(df: DataFrame, by: list[str], key: str, x: str, y: str) -> DataFrame:
    """Tau-a over the pairs of a group. With rows in order of x, then y, the pairs that fall are those that a merge sort by y
    swaps; ties are counted by value. A group's two columns are sorted in one task, in time n log n; rows of one key or
    without one make no pairs, those without a value pairs that count for nothing."""
    v = df.select(*by, F.col(key).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_k IS NOT NULL")
    names = [f"_by{i}" for i in range(len(by))]
    v = v.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], "_k", "_x", "_y")

    def net(a: np.ndarray, b: np.ndarray) -> int:
        """Rising less falling pairs."""
        n = len(a)
        at = np.lexsort((b, a))
        rank = np.unique(b[at], return_inverse=True)[1].astype(np.int64).ravel()
        ties = lambda *c: int(sum(t * (t - 1) // 2 for t in np.unique(np.stack(c, 1), axis=0, return_counts=True)[1].tolist()))
        falling, width, span = 0, 1, int(rank.max(initial=0)) + 1
        place = np.arange(n, dtype=np.int64)
        while width < n:  # sorted runs of this width are merged two by two
            run = place // width
            offset = (run // 2) * span
            own = rank + offset
            left = run % 2 == 0
            upto = np.searchsorted(own[left], own[~left], side="right")
            ends = np.searchsorted(own[left], offset[~left] + span, side="left")
            falling += int((ends - upto).sum())
            rank = np.sort(own, kind="stable") - np.sort(offset, kind="stable")
            width *= 2
        return n * (n - 1) // 2 - ties(a) - ties(b) + ties(a, b) - 2 * falling

    def one(t: pa.Table) -> pa.Table:
        k, a, b = (t.column(c).to_numpy(zero_copy_only=False) for c in ("_k", "_x", "_y"))
        pairs = lambda ks: int(sum(c * (c - 1) // 2 for c in np.unique(ks, return_counts=True)[1].tolist()))
        ok = ~(np.isnan(a) | np.isnan(b))
        k, a, b = k[ok], a[ok], b[ok]
        n = len(a) * (len(a) - 1) // 2 - pairs(k)
        total = net(a, b)
        if pairs(k):  # pairs within a key go
            order = np.argsort(k, kind="stable")
            for part in np.split(order, np.nonzero(np.diff(np.unique(k[order], return_inverse=True)[1].ravel()))[0] + 1):
                total -= net(a[part], b[part]) if len(part) > 1 else 0
        keys = [t.column(c).slice(0, 1) for c in names]
        return pa.table([*keys, pa.array([total / n if n else None], pa.float64()), pa.array([t.num_rows * (t.num_rows - 1) // 2 - pairs(t.column("_k").to_numpy(zero_copy_only=False))], pa.int64())], [*names, "tau", "_n"])

    schema = "".join(f"{n} {v.schema[n].dataType.simpleString()}, " for n in names) + "tau double, _n long"
    out = v.groupBy(*names).applyInArrow(one, schema).where("_n > 0")  # no row for a group without pairs
    return out.select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=True)], "tau")


def correlation_matrix(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Pearson coefficients of all pairs of columns, long, in one aggregation."""
    by = by or []
    pairs = [(a, b) for a in cols for b in cols]
    row = df.groupBy(*by).agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(*by, F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def sample_correlation(df: DataFrame, item: str, sample: str, value: str) -> DataFrame:
    """Pearson coefficients of all pairs of samples over their common items; as many rows as an item has samples squared."""
    a = df.select(item, F.col(sample).alias("a"), F.col(value).alias("_x"))
    b = df.select(item, F.col(sample).alias("b"), F.col(value).alias("_y"))
    return a.join(b, item).groupBy("a", "b").agg(F.corr("_x", "_y").alias("r"))


def bh_adjust(df: DataFrame, by: list[str], p: str, tie: list[str], out: str = "padj") -> DataFrame:
    """Benjamini-Hochberg: the running minimum of p * m / rank from the largest p; without groups on two levels."""
    if not by:
        m = df.agg(F.count(p).alias("_m"))
        v = ranked(df.where(F.col(p).isNotNull()), [], F.col(p), [F.col(c) for c in tie]).crossJoin(F.broadcast(m))  # one row
        v = materialize(v, "ranked")  # read twice below
        cut, bucket = along(v.withColumn("_q", F.col(p) * F.col("_m") / F.col("_k")), [], F.col("_k"), descending=True)
        v = running(cut, [], bucket, [F.col("_k").desc()], {out: ("min", F.col("_q"), True)}).withColumn(out, F.least(F.col(out), F.lit(1.0)))
        return v.select(*df.columns, out).unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))
    w = Window.partitionBy(*(by or [F.lit(1)]))
    v = df.withColumns({"_m": F.count(p).over(w), "_k": F.row_number().over(w.orderBy(F.col(p).asc_nulls_last(), *tie))})
    q = F.min(F.col(p) * F.col("_m") / F.col("_k")).over(w.orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return v.withColumn(out, F.when(F.col(p).isNotNull(), F.least(q, F.lit(1.0)))).drop("_m", "_k")


# --- Dose response ----------------------------------------------------------------------------------------------------


def logistic(x: np.ndarray, upper: float, ic50: float, slope: float, lower: float) -> np.ndarray:
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return lower + (upper - lower) / (1 + np.where(x > 0, (x / ic50) ** slope, 0.0 if slope > 0 else np.inf))


def fit_logistic(x: np.ndarray, y: np.ndarray, robust: bool = False, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, bool]:
    """Upper, log10 IC50, slope, lower by Levenberg-Marquardt (Huber weights if robust): values, half widths, converged."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    none = np.full(4, np.nan)
    if len(x) < 5 or len(np.unique(x)) < 4 or np.ptp(y) == 0:
        return none, none, False
    pos = x[x > 0]
    rising = np.corrcoef(np.argsort(np.argsort(x)), y)[0, 1] > 0
    p = np.array([y.max(), np.log10(np.sqrt(pos.min() * pos.max())), -1.0 if rising else 1.0, y.min()])
    f = lambda q: logistic(x, q[0], 10.0 ** q[1], q[2], q[3])
    weight, lam, done = np.ones(len(x)), 1e-2, False

    def jacobian(q: np.ndarray) -> np.ndarray:
        h = 1e-6 * np.maximum(1, np.abs(q))
        return np.stack([(f(q + h[i] * np.eye(4)[i]) - f(q - h[i] * np.eye(4)[i])) / (2 * h[i]) for i in range(4)], axis=1)

    for _ in range(rounds):
        r = y - f(p)
        if robust:
            s = max(1e-12, 1.4826 * np.median(np.abs(r - np.median(r))))
            weight = np.minimum(1, 1.345 * s / np.maximum(np.abs(r), 1e-12))
        j = jacobian(p)
        a, g = j.T @ (weight[:, None] * j), j.T @ (weight * r)
        try:
            step = np.linalg.solve(a + lam * np.diag(np.diag(a) + 1e-12), g)
        except np.linalg.LinAlgError:
            break
        new = p + step
        if np.isfinite(f(new)).all() and (weight * (y - f(new)) ** 2).sum() <= (weight * r**2).sum():
            done = bool(np.abs(step).max() < 1e-8 * (1 + np.abs(p).max()))
            p, lam = new, max(lam / 5, 1e-12)
            if done:
                break
        else:
            lam *= 4
            if lam > 1e12:
                done = bool((weight * r**2).sum() < 1e-12 * (1 + (y**2).sum())) or bool(np.abs(g).max() < 1e-6 * (1 + np.abs(y).max()))
                break
    try:
        cov = np.linalg.inv(jacobian(p).T @ jacobian(p)) * ((y - f(p)) ** 2).sum() / max(1, len(x) - 4)
        half = 1.96 * np.sqrt(np.maximum(0, np.diag(cov)))
    except np.linalg.LinAlgError:
        half = none
    return p, half, done


def fit_dose_response(df: DataFrame, by: list[str], dose: str = "dose", response: str = "response", robust: bool = False) -> DataFrame:
    """Four-parameter logistic fit by group: upper, ic50, slope, lower, half widths of their 95 % intervals, converged.

    One group is one curve (tens of points), so it fits in a task's memory.
    """
    names = ["upper", "ic50", "slope", "lower"]

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        p, half, done = fit_logistic(frame[dose].to_numpy(float), frame[response].to_numpy(float), robust)
        ic50 = 10 ** p[1]
        values = [p[0], ic50, p[2], p[3], half[0], ic50 * np.log(10) * half[1], half[2], half[3]]
        return pd.DataFrame([[*keys, *values, bool(done), "huber" if robust else "none", len(frame)]], columns=schema.names)

    schema = df.select(*by).schema
    schema = reduce(lambda s, n: s.add(n, "double"), names + [f"{n}_ci" for n in names], schema).add("converged", "boolean").add("robust", "string").add("n", "long")
    return df.select(*by, dose, response).groupBy(*by).applyInPandas(run, schema)


def inhibition_dose(fit: DataFrame, percents: tuple[float, ...] = (10, 50, 90)) -> DataFrame:
    """Doses that give so many percent of the full effect."""
    return fit.withColumns({f"ic{round(p)}": F.col("ic50") * F.pow(F.lit(p / (100.0 - p)), ratio(F.lit(1.0), F.col("slope"))) for p in percents if p != 50})


def predict_curve(fit: DataFrame, by: list[str], low: str = "low", high: str = "high", n: int = 200) -> DataFrame:
    """Points of the fitted curves on a logarithmic grid from 0.8 low to 1.2 high."""
    x = F.expr(f"explode(transform(sequence(0, {n - 1}), i -> exp(ln({low} * 0.8D) + i * (ln({high} * 1.2D) - ln({low} * 0.8D)) / {n - 1})))").alias("x")
    grid = fit.select(*by, "upper", "ic50", "slope", "lower", x)
    return grid.select(*by, "x", F.expr("lower + (upper - lower) / (1 + power(x / ic50, slope))").alias("y"))


def bootstrap_band(df: DataFrame, by: list[str], dose: str = "dose", response: str = "response", repeats: int = 200, seed: int = 1) -> DataFrame:
    """Curve with a 95 % band from refits on resampled residuals: x, y, ymin, ymax."""

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[dose].to_numpy(float), frame[response].to_numpy(float)
        p, _, _ = fit_logistic(x, y)
        pos = x[x > 0]
        if not np.isfinite(p).all() or not len(pos):
            return pd.DataFrame(columns=schema.names)
        grid = np.exp(np.linspace(np.log(pos.min() * 0.8), np.log(pos.max() * 1.2), 200))
        curve = lambda q: logistic(grid, q[0], 10 ** q[1], q[2], q[3])
        fitted = logistic(x, p[0], 10 ** p[1], p[2], p[3])
        rng = np.random.default_rng(seed)
        draws = [curve(q) for q in (fit_logistic(x, fitted + rng.permutation(y - fitted), rounds=40)[0] for _ in range(repeats)) if np.isfinite(q).all()]
        low, high = np.percentile(draws, [2.5, 97.5], axis=0) if draws else (curve(p), curve(p))
        out = pd.DataFrame({"x": grid, "y": curve(p), "ymin": low, "ymax": high})
        for name, k in zip(by, keys, strict=True):
            out.insert(0, name, k)
        return out[schema.names]

    schema = reduce(lambda s, n: s.add(n, "double"), ["x", "y", "ymin", "ymax"], df.select(*by).schema)
    return df.select(*by, dose, response).groupBy(*by).applyInPandas(run, schema)


def dose_summary(df: DataFrame, by: list[str], dose: str, response: str) -> DataFrame:
    """Mean and standard error by dose."""
    return df.groupBy(*by, dose).agg(F.avg(clean(response)).alias("mean"), (F.stddev_samp(clean(response)) / F.sqrt(F.count(clean(response)).cast("double"))).alias("se"))


def top_inhibition(df: DataFrame, by: list[str], mean: str = "mean") -> DataFrame:
    return df.groupBy(*by).agg((100 * (1 - ratio(F.min(mean), F.max(mean)))).alias("top_inhibition"))


def curve_derivative(df: DataFrame, by: list[str], x: str, y: str, points: int = 100, penalty: float = 1.0) -> DataFrame:
    """First derivative of a smoothed curve on a grid: penalised cubic splines by group; the melting point is its extreme."""

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.dropna().sort_values(x)
        a, b = f[x].to_numpy(float), f[y].to_numpy(float)
        if len(a) < 6 or np.ptp(a) == 0:
            return pd.DataFrame(columns=schema.names)
        knots = np.linspace(a.min(), a.max(), min(20, len(a)))
        s = (a - a.min()) / np.ptp(a)
        k = (knots - a.min()) / np.ptp(a)
        basis = lambda t: np.column_stack([np.ones_like(t), t, t**2, t**3, *[np.maximum(0, t - c) ** 3 for c in k[1:-1]]])
        slope = lambda t: np.column_stack([np.zeros_like(t), np.ones_like(t), 2 * t, 3 * t**2, *[3 * np.maximum(0, t - c) ** 2 for c in k[1:-1]]])
        m = basis(s)
        d = np.diag([0.0] * 4 + [penalty * 1e-4] * (m.shape[1] - 4))
        inv = np.linalg.pinv(m.T @ m + d)
        w = inv @ (m.T @ b)
        sigma2 = ((b - m @ w) ** 2).sum() / max(1, len(a) - m.shape[1] / 2)
        grid = np.linspace(0, 1, points)
        g = slope(grid)
        out = pd.DataFrame({x: a.min() + grid * np.ptp(a), "derivative": g @ w / np.ptp(a), "se": np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", g, inv, g) * sigma2)) / np.ptp(a)})
        for name, key in zip(by, keys, strict=True):
            out.insert(0, name, key)
        return out[schema.names]

    schema = reduce(lambda s, n: s.add(n, "double"), [x, "derivative", "se"], df.select(*by).schema)
    return df.select(*by, x, y).groupBy(*by).applyInPandas(run, schema)


def average_curves(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by, x).agg(F.avg(clean(y)).alias(y))


def minmax_scale(df: DataFrame, x: str, low: float = 0.0, high: float = 1.0, by: list[str] | None = None, out: str | None = None) -> DataFrame:
    """Scaled to 0..1 by the bounds after clipping; a constant column gives 0.5. The two bounds come from one aggregation."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    a, b = F.min(clean(x)).over(w), F.max(clean(x)).over(w)
    if not by:
        bounds = df.agg(F.min(clean(x)).alias("_a"), F.max(clean(x)).alias("_b"))
        df, a, b = df.crossJoin(F.broadcast(bounds)), F.col("_a"), F.col("_b")  # one row
    s = F.when(a == b, 0.5).otherwise(ratio(clean(x) - a, b - a)) * (high - low) + low
    return df.withColumn(out or x, s).drop("_a", "_b")
