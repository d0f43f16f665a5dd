"""Numeric helpers: significant digits, grids, geometry, vectors, images and distribution tails without scipy."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType


def signif(x: Column, digits: int) -> Column:
    """Rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def log2_fold(a: Column, b: Column, pseudo: float = 1.0) -> Column:
    return F.log2((a + pseudo) / (b + pseudo))


def euclid(a: str, b: str) -> Column:
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> CAST((x - y) AS DOUBLE) * (x - y)), 0D, (s, d) -> s + d))")


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, d) -> s + d)")


def cosine(a: str, b: str) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def tanimoto(a: str, b: str) -> Column:
    """Of two bit vectors in arrays of longs; null if both are empty."""
    both = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x & y)), 0, (s, n) -> s + n)"
    either = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x | y)), 0, (s, n) -> s + n)"
    return F.expr(f"try_divide(CAST({both} AS DOUBLE), CAST({either} AS DOUBLE))")


def sign_bits(vector: str) -> Column:
    """Bits of the signs of a vector, 32 a long."""
    return F.expr(f"transform(sequence(0, (size({vector}) - 1) div 32), w -> aggregate(transform(slice({vector}, w * 32 + 1, 32), (x, i) -> IF(x > 0, shiftleft(1L, i), 0L)), 0L, (s, b) -> s | b))")


def log_grid(low: str, high: str, n: int = 200) -> Column:
    """n points evenly spaced in the logarithm from low * 0.8 to high * 1.2."""
    return F.expr(f"transform(sequence(0, {n - 1}), i -> exp(ln({low} * 0.8D) + i * (ln({high} * 1.2D) - ln({low} * 0.8D)) / {n - 1}))")


def point_in_polygon(x: str, y: str, polygon: list[tuple[float, float]]) -> Column:
    """Ray casting over a literal polygon."""
    edges = [(a, b, c, d) for (a, b), (c, d) in zip(polygon, polygon[1:] + polygon[:1], strict=True)]
    listed = "array(" + ", ".join(f"named_struct('a', {a}D, 'b', {b}D, 'c', {c}D, 'd', {d}D)" for a, b, c, d in edges) + ")"
    hit = f"(e.b > {y}) != (e.d > {y}) AND {x} < (e.c - e.a) * ({y} - e.b) / nullif(e.d - e.b, 0D) + e.a"
    return F.expr(f"aggregate({listed}, false, (s, e) -> s != coalesce({hit}, false))")


def row_sum(cols: list[str]) -> Column:
    """Horizontal sum without nulls; null if all are."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0.0)))
    return F.when(F.coalesce(*[F.col(c) for c in cols]).isNotNull(), total)


def row_mean(cols: list[str]) -> Column:
    n = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    return F.try_divide(row_sum(cols), n.cast("double"))


def normalize_pixels(pixels: pd.Series, method: str = "minmax", reset_zero: bool = False) -> pd.Series:
    """Arrays of pixels scaled by their non-zero part: ``scale`` (by the maximum), ``percentile`` (0.1 to 99.9), ``minmax``."""

    def one(p):
        v = np.asarray(p, float)
        part = v[v != 0]
        if not len(part):
            return v.tolist()
        if method == "scale":
            out = v / part.max()
        else:
            low, high = np.percentile(part, [0.1, 99.9]) if method == "percentile" else (part.min(), part.max())
            out = (v - low) / (high - low) if high > low else np.zeros_like(v)
        return np.where(v == 0, 0.0, out).tolist() if reset_zero else out.tolist()

    return pixels.map(one)


def pixel_normalizer(method: str = "minmax", reset_zero: bool = False):
    """A column function on arrays of double."""

    @pandas_udf(ArrayType(DoubleType()))
    def run(pixels: pd.Series) -> pd.Series:
        return normalize_pixels(pixels, method, reset_zero)

    return run


# --- Distribution tails, in column expressions ------------------------------------------------------------------------

#: Lanczos coefficients of the logarithm of the gamma function, g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Numerators and denominators of the normal quantile (algorithm AS 241): centre, middle, far tail.
CENTRE = ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727), (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610))
MIDDLE = ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640), (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9))
TAIL = ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 2.01033439929228813265e-7), (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 0.0000184631831751005468180, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def lgamma_sql(x: str) -> str:
    """SQL of ln gamma(x) for x of at least 0.5."""
    series = f"{LANCZOS[0]}D" + "".join(f" + {c}D / (z + {i}D)" for i, c in enumerate(LANCZOS[1:], 1))
    return f"element_at(transform(array(CAST({x} AS DOUBLE) - 1D), z -> (z + 0.5D) * ln(z + 7.5D) - (z + 7.5D) + 0.9189385332046727D + ln({series})), 1)"


def choose_sql(n: str, k: str) -> str:
    """SQL of ln (n over k)."""
    return f"({lgamma_sql(f'({n}) + 1')} - {lgamma_sql(f'({k}) + 1')} - {lgamma_sql(f'({n}) - ({k}) + 1')})"


def beta_sql(a: str, b: str, x: str) -> str:
    """SQL of the regularised incomplete beta function for 0 < x < 1 at names of columns or variables: the continued
    fraction by Lentz's rule, in the half where it converges fast."""

    def half(a: str, b: str, x: str) -> str:
        front = f"exp({a} * ln({x}) + {b} * ln(1D - {x}) + {lgamma_sql(f'{a} + {b}')} - {lgamma_sql(a)} - {lgamma_sql(b)}) / {a}"
        safe = lambda v: f"IF(abs({v}) < 1e-300D, 1e-300D, {v})"

        def step(state: str, num: str) -> str:
            d, c = safe(f"(1D + {num} * {state}.d)"), safe(f"(1D + {num} / {state}.c)")
            return f"element_at(transform(array(named_struct('d', 1D / {d}, 'c', {c}, 'f', {state}.f)), t -> named_struct('d', t.d, 'c', t.c, 'f', t.f * t.d * t.c)), 1)"

        even = f"(m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m)))"
        odd = f"(-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1)))"
        first = f"1D / {safe(f'(1D - ({a} + {b}) * {x} / ({a} + 1D))')}"
        both = f"element_at(transform(array({step('s', even)}), u -> {step('u', odd)}), 1)"
        rest = f"aggregate(sequence(1, 200), named_struct('d', {first}, 'c', 1D, 'f', {first}), (s, m) -> IF(abs(s.c * s.d - 1D) < 1e-15D, s, {both}), s -> s.f)"
        return f"({front} * {rest})"

    return f"IF({x} <= ({a} + 1D) / ({a} + {b} + 2D), {half(a, b, x)}, 1D - {half(b, a, f'(1D - {x})')})"


def t_pvalue(t: str, df: str) -> Column:
    """Two-sided tail of Student's t; null if either is null or NaN or there are no degrees of freedom."""
    body = beta_sql("p.a", "0.5D", "p.x")
    return F.expr(
        f"CASE WHEN {t} IS NULL OR {df} IS NULL OR isnan(CAST({t} AS DOUBLE)) OR NOT {df} > 0 THEN CAST(NULL AS DOUBLE) WHEN {t} = 0 THEN 1D "
        f"ELSE element_at(transform(array(named_struct('a', {df} / 2D, 'x', {df} / ({df} + {t} * {t}))), p -> IF(p.x <= 0D, 0D, {body})), 1) END"
    )


def normal_two_sided(z: str) -> Column:
    """Two-sided tail of the normal distribution: erfc(|z| / sqrt 2), as a series below 2.5, else a continued fraction."""
    series = "aggregate(sequence(1, 120), named_struct('t', x, 's', x), (s, n) -> named_struct('t', s.t * 2D * x * x / (2 * n + 1), 's', s.s + s.t * 2D * x * x / (2 * n + 1)), s -> 1D - 1.1283791670955126D * exp(-x * x) * s.s)"
    fraction = "0.5641895835477563D * exp(-x * x) / aggregate(transform(sequence(0, 79), i -> 80 - i), x, (f, k) -> x + k / 2D / f)"
    return F.expr(f"CASE WHEN {z} IS NULL OR isnan(CAST({z} AS DOUBLE)) THEN CAST(NULL AS DOUBLE) ELSE element_at(transform(array(abs(CAST({z} AS DOUBLE)) / sqrt(2D)), x -> IF(x < 2.5D, {series}, {fraction})), 1) END")


def probit(p: Column) -> Column:
    """Normal quantile of probabilities strictly between 0 and 1, else null."""
    q = p - 0.5
    poly = lambda cs, x: reduce(lambda acc, c: acc * x + c, reversed(cs[:-1]), F.lit(cs[-1]))
    r = 0.180625 - q * q
    t = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(t <= 5, poly(MIDDLE[0], t - 1.6) / poly(MIDDLE[1], t - 1.6)).otherwise(poly(TAIL[0], t - 5) / poly(TAIL[1], t - 5))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * poly(CENTRE[0], r) / poly(CENTRE[1], r)).otherwise(F.signum(q) * tail))


def hypergeom_pvalue(k: str, total: str, good: str, drawn: str) -> Column:
    """P(at least k good ones among the drawn)."""
    low = f"greatest({k}, {drawn} - ({total} - {good}), 0)"
    term = f"exp({choose_sql(good, 'i')} + {choose_sql(f'{total} - {good}', f'{drawn} - i')} - {choose_sql(total, drawn)})"
    return F.expr(f"IF({low} > least({good}, {drawn}), 0D, least(1D, aggregate(sequence({low}, least({good}, {drawn})), 0D, (s, i) -> s + {term})))")


def fisher_pvalue(a: str, b: str, c: str, d: str) -> Column:
    """Two-sided exact test of a 2 x 2 table: the tables that are no likelier."""
    row, col, n = f"({a} + {b})", f"({a} + {c})", f"({a} + {b} + {c} + {d})"
    log = lambda i: f"({choose_sql(row, i)} + {choose_sql(f'{n} - {row}', f'{col} - {i}')} - {choose_sql(n, col)})"
    return F.expr(f"element_at(transform(array({log(a)}), o -> least(1D, aggregate(transform(sequence(greatest(0, {col} - ({n} - {row})), least({row}, {col})), i -> {log('i')}), 0D, (s, l) -> s + IF(l <= o + 1e-7D, exp(l), 0D)))), 1)")
