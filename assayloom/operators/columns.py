"""Column selection, renaming and row-wise derivation by role and pattern. Names are resolved on the driver, values in one select."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.maths import row_mean
from assayloom.functions.nulls import clip, ratio


def matching(df: DataFrame, *patterns: str, drop: bool = False) -> list[str]:
    """Names that match (or don't match) any of the patterns."""
    return [c for c in df.columns if any(re.search(p, c) for p in patterns) != drop]


def select_roles(df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    names = matching(df, *keep) if keep else df.columns
    gone = set(matching(df, *drop)) if drop else set()
    return df.select(*[F.col(f"`{c}`") for c in names if c not in gone])


def rename_with(df: DataFrame, f: Callable[[str], str], cols: list[str] | None = None) -> DataFrame:
    return df.withColumnsRenamed({c: f(c) for c in (cols or df.columns)})


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return rename_with(df, lambda c: c.removeprefix(prefix))


def rename_channels(df: DataFrame, channels: dict[str, str]) -> DataFrame:
    """Replace channel names where they stand as a part of a column name."""

    def f(c: str) -> str:
        return "_".join(channels.get(p, p) for p in c.split("_"))

    return rename_with(df, f)


def across(df: DataFrame, cols: list[str], f: Callable[[Column], Column], suffix: str = "") -> DataFrame:
    """The same expression over many columns, in one projection."""
    return df.withColumns({c + suffix: f(F.col(f"`{c}`")) for c in cols})


def relocate(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def clean_names(df: DataFrame) -> DataFrame:
    """Snake case; clashes get a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", c)
        n = re.sub(r"[^0-9A-Za-z]+", "_", n).strip("_").lower() or "x"
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def remove_constant(df: DataFrame) -> DataFrame:
    """Without columns of a single value (null counts as a value); one aggregation over all columns."""
    aggs = [a for i, c in enumerate(df.columns) for a in (F.min(F.struct(f"`{c}`")).alias(f"a{i}"), F.max(F.struct(f"`{c}`")).alias(f"b{i}"))]
    row = df.agg(*aggs).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if row[f"a{i}"] != row[f"b{i}"]])


def remove_empty(df: DataFrame) -> DataFrame:
    """Without columns that hold nothing but nulls."""
    row = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if row[f"n{i}"]])


def filter_all(df: DataFrame, cols: list[str], p: Callable[[Column], Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [p(F.col(c)) for c in cols], F.lit(True)))


def filter_any(df: DataFrame, cols: list[str], p: Callable[[Column], Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [p(F.col(c)) for c in cols], F.lit(False)))


def case_when(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule that holds."""
    out = None
    for test, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, v) if out is None else out.when(test, v)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def good_reads(df: DataFrame, min_mapq: int = 30, need: int = 2, never: int = 1804, chrom: str = "^(chr)?([0-9]+|X|Y)$") -> DataFrame:
    """Alignments that are properly paired, map well, carry no excluded flag and lie on main chromosomes."""
    return df.where((F.col("flag").bitwiseAND(need) == need) & (F.col("flag").bitwiseAND(never) == 0) & (F.col("mapq") >= min_mapq) & F.col("rname").rlike(chrom))


def standard_chromosomes(df: DataFrame, chrom: str = "chrom", prefix: bool = True) -> DataFrame:
    """Ranges on chromosomes 1.., X and Y, with or without the prefix chr."""
    bare = F.regexp_replace(chrom, "^chr", "")
    return df.where(bare.rlike("^([0-9]+|X|Y)$")).withColumn(chrom, F.concat(F.lit("chr"), bare) if prefix else bare)


def subtract_background(df: DataFrame, pairs: dict[str, str], area: str | None = None) -> DataFrame:
    """max(x - background, 0) by column; with ``area``: max(x - background * area, 0)."""
    return df.withColumns({x: clip(F.col(x) - F.col(bg) * (F.col(area) if area else 1.0), 0, None) for x, bg in pairs.items()})


def pixel_to_um(df: DataFrame, lengths: str, areas: str, scale: float) -> DataFrame:
    """Lengths times the scale, areas times its square, by name patterns."""
    cols = {c: F.col(c) * scale for c in matching(df, lengths)} | {c: F.col(c) * scale * scale for c in matching(df, areas)}
    return df.withColumns(cols)


def ratio_columns(df: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({name: ratio(F.col(a), F.col(b)) for name, (a, b) in ratios.items()})


def replace_na(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna(values)


def average_directions(df: DataFrame, pattern: str = r"^((?:.*_)?Texture)_([A-Za-z0-9]+)_(.+)_([0-9]+)_([0-9]{2})_([0-9]+)$") -> DataFrame:
    """Mean of the texture columns of all directions (the part before the last) in one column each; an object's name may
    stand before them."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        if m := re.match(pattern, c):
            groups.setdefault(f"{m[1]}_{m[2]}_{m[3]}_{m[4]}_{m[6]}", []).append(c)
    used = {c for cs in groups.values() for c in cs}
    return df.select(*[F.col(c) for c in df.columns if c not in used], *[row_mean(cs).alias(n) for n, cs in groups.items()])
