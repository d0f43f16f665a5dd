"""Joins, reshaping, top-k, sampling and set operations with the missing-value rules of data-frame verbs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", null_safe: bool = True) -> DataFrame:
    """Equi-join on names in which null matches null; keys come once, from the left (from either side in an outer join)."""
    if not null_safe:
        return left.join(right, on, how)
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    test = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    joined = left.join(renamed, test, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("outer", "full", "right"):
        joined = joined.withColumns({c: F.coalesce(c, f"_r_{c}") for c in on})
    return joined.drop(*[f"_r_{c}" for c in on])


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return null_safe_join(left, right, shared(left, right))


def join_dimension(fact: DataFrame, dim: DataFrame, on: list[str] | None = None) -> DataFrame:
    """All facts with the dimension's columns first."""
    on = on or shared(fact, dim)
    out = null_safe_join(fact, dim, on)
    first = dim.columns
    return out.select(*first, *[c for c in out.columns if c not in first])


def join_suffixed(left: DataFrame, right: DataFrame, on: list[str], suffix: tuple[str, str]) -> DataFrame:
    """Left join in which columns of both sides other than the keys get suffixes."""
    both = [c for c in shared(left, right) if c not in on]
    return null_safe_join(left.withColumnsRenamed({c: c + suffix[0] for c in both}), right.withColumnsRenamed({c: c + suffix[1] for c in both}), on)


def outer_keep_right(left: DataFrame, right: DataFrame, on: list[str], need: str) -> DataFrame:
    """Full outer join without the rows whose needed column is null."""
    return null_safe_join(left, right, on, "outer").where(F.col(need).isNotNull())


def join_all(tables: list[DataFrame], on: list[str]) -> DataFrame:
    return reduce(lambda a, b: null_safe_join(a, b, on), tables)


def flag_members(df: DataFrame, hits: DataFrame, on: str, flag: str = "is_hit") -> DataFrame:
    """Left join with one row per hit key, and whether there was one."""
    first = Window.partitionBy(on).orderBy(*[F.col(c) for c in hits.columns if c != on])
    one = hits.where(F.col(on).isNotNull()).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").withColumn(flag, F.lit(True))
    return df.join(one, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def resolve_alias(df: DataFrame, symbol: str, dim: DataFrame) -> DataFrame:
    """Approved symbol of each name: as it is, else by previous, else by alias symbol; unknown names stay. One row each.

    dim: approved_symbol, previous_symbol, alias_symbol. The old name is kept as ``<symbol>_old``.
    """
    parts = [dim.select(F.col(c).alias("_name"), F.lit(rank).alias("_rank"), F.col("approved_symbol").alias("_to")) for rank, c in enumerate(("approved_symbol", "previous_symbol", "alias_symbol"))]
    names = reduce(DataFrame.unionByName, parts).where("_name IS NOT NULL").groupBy("_name").agg(F.min(F.struct("_rank", "_to"))["_to"].alias("_to"))
    out = df.join(names, df[symbol] == names["_name"], "left")
    return out.withColumn(f"{symbol}_old", F.col(symbol)).withColumn(symbol, F.coalesce("_to", symbol)).drop("_name", "_to")


def near_pairs(a: DataFrame, b: DataFrame, radius: float, keys: tuple[str, ...] = ("id",), axes: tuple[str, ...] = ("x", "y", "z"), within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points nearer than the radius: a grid of that width, each point of ``a`` looks into its 3**d cells."""
    cell = [F.floor(F.col(c) / radius).cast("long").alias(f"_c{c}") for c in axes]
    around = a.select("*", *cell)
    for c in axes:
        around = around.withColumn(f"_c{c}", F.explode(F.expr(f"array(_c{c} - 1, _c{c}, _c{c} + 1)")))
    used = [*within, *[f"_c{c}" for c in axes]]
    right = b.select(*within, *cell, *[F.col(c).alias(f"{c}_b") for c in (*keys, *axes, *[c for c in b.columns if c not in (*keys, *axes, *within)])])
    distance = F.sqrt(reduce(lambda p, q: p + q, [F.pow(F.col(c) - F.col(f"{c}_b"), 2) for c in axes]))
    return around.join(right, used).withColumn("distance", distance).where(F.col("distance") < radius).drop(*[f"_c{c}" for c in axes])


def zip_rows(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """Rows of both tables with the same number; stops at the shorter one."""
    return a.join(b, index)


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """A running number from 1 by a total order, for lists."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def bind_columns(a: DataFrame, order_a: list[str], b: DataFrame, order_b: list[str]) -> DataFrame:
    """Columns of two lists of one length side by side, the rows of each by its own order; raises if lengths differ."""
    left, right = numbered(a, order_a, "_row").withColumn("_here", F.lit(True)), numbered(b, order_b, "_row").withColumn("_there", F.lit(True))
    both, first = left.join(right, "_row", "full"), a.columns[0]
    uneven = F.col("_there").isNull() | F.col("_here").isNull()
    checked = F.when(uneven, F.raise_error(F.lit("the tables differ in length")).cast(a.schema[first].dataType)).otherwise(F.col(first))
    return both.withColumn(first, checked).drop("_row", "_here", "_there")


def split_apply(df: DataFrame, key: str, call: Callable[[DataFrame], DataFrame], most: int = 1000) -> DataFrame:
    """A function of each part of a table by key, put together; for up to so many parts, whose keys reach the driver. What a
    window or a grouped aggregate can say needs no parts."""
    keys = [r[0] for r in df.select(key).distinct().orderBy(key).limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"more than {most} parts")
    parts = [call(df.where(F.col(key).eqNullSafe(F.lit(k)))) for k in keys]
    return reduce(DataFrame.unionByName, parts) if parts else call(df)


# --- Reshaping --------------------------------------------------------------------------------------------------------


def longer(df: DataFrame, ids: list[str], cols: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def longer_multi(df: DataFrame, ids: list[str], sep: str = "_", key: str = "key") -> DataFrame:
    """a_x, a_y, b_x, b_y to key, x, y: the part after the last separator names the value column."""
    parts: dict[str, dict[str, str]] = {}
    for c in df.columns:
        if c not in ids and sep in c:
            k, _, v = c.rpartition(sep)
            parts.setdefault(k, {})[v] = c
    values = sorted({v for p in parts.values() for v in p})
    rows = [F.struct(F.lit(k).alias(key), *[(F.col(p[v]).cast("double") if v in p else F.lit(None).cast("double")).alias(v) for v in values]) for k, p in sorted(parts.items())]
    return df.select(*ids, F.inline(F.array(*rows)))


def wider(df: DataFrame, ids: list[str], name: str, values: list[str], value: str, how=F.first, prefix: str = "") -> DataFrame:
    """One column per listed value of ``name``."""
    out = df.groupBy(*ids).pivot(name, values).agg(how(value))
    return out.withColumnsRenamed({v: prefix + v for v in values})


def wider_multi(df: DataFrame, ids: list[str], name: str, values: list[str], aggs: dict[str, Column], glue: str = "{value}_{name}") -> DataFrame:
    """Several value columns by name; column names by a template."""
    out = df.groupBy(*ids).pivot(name, values).agg(*[c.alias(k) for k, c in aggs.items()])
    if len(aggs) == 1:
        return out.withColumnsRenamed({v: glue.format(name=v, value=next(iter(aggs))) for v in values})
    return out.withColumnsRenamed({f"{v}_{k}": glue.format(name=v, value=k) for v in values for k in aggs})


def unite(cols: list[str], sep: str = "_", na: str = "NA") -> Column:
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(na)) for c in cols])


def separate(x: Column, sep: str, names: list[str]) -> list[Column]:
    """Parts of a string by a separator pattern; missing ones are null."""
    return [F.try_element_at(F.split(x, sep, -1), F.lit(i)).alias(n) for i, n in enumerate(names, 1)]


def separate_regex(x: Column, pieces: list[tuple[str | None, str]]) -> list[Column]:
    """Named pieces of an ordered regular expression; null where the whole doesn't match or a piece is empty."""
    pattern = "^" + "".join(f"({p})" for _, p in pieces) + "$"
    return [F.nullif(F.regexp_extract(x, pattern, i), F.lit("")).alias(n) for i, (n, _) in enumerate(pieces, 1) if n]


def separate_position(x: Column, widths: list[tuple[str, int]]) -> list[Column]:
    out, at = [], 1
    for n, w in widths:
        out.append(F.substring(x, at, w).alias(n))
        at += w
    return out


def nest(df: DataFrame, by: list[str], name: str = "data") -> DataFrame:
    return df.groupBy(*by).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in by])).alias(name))


def unnest(df: DataFrame, name: str = "data") -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], F.inline(name))


def crossing(a: DataFrame, b: DataFrame) -> DataFrame:
    """All combinations of the distinct rows of two small tables."""
    return a.distinct().crossJoin(b.distinct())


def expand_grid(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.crossJoin(b)


def one_hot(df: DataFrame, ids: list[str], seq: str, alphabet: str = "ACDEFGHIKLMNPQRSTVWY") -> DataFrame:
    """A row for each place of a sequence, a 0/1 column for each letter."""
    placed = df.select(*ids, F.posexplode(F.split(seq, "")).alias("position", "_c")).where("_c <> ''")
    return placed.select(*ids, (F.col("position") + 1).alias("position"), *[(F.col("_c") == a).cast("int").alias(a) for a in alphabet])


# --- Order, top-k, sampling -------------------------------------------------------------------------------------------


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int = 1, ties: bool = False) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_k", (F.rank() if ties else F.row_number()).over(w)).where(F.col("_k") <= k).drop("_k")


def distinct_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order)


def hashed_unit(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the md5 of a key, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample_per_class(df: DataFrame, by: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each class, chosen by hash."""
    return top_k(df, by, [hashed_unit(F.col(key), seed), F.col(key)], n)


def split_train(df: DataFrame, key: str, share: float = 0.75, seed: int = 0) -> DataFrame:
    """``set``: train or test, by the hash of the key."""
    return df.withColumn("set", F.when(hashed_unit(F.col(key), seed) < share, "train").otherwise("test"))


def split_ratio(df: DataFrame, key: str, ratios: list[float], seed: int = 0) -> DataFrame:
    """``rep`` 1..n by cumulative ratios; equal keys (mates) go together. Ratios must sum to 1."""
    if abs(sum(ratios) - 1) > 1e-6 or min(ratios) < 0:
        raise ValueError("ratios must be non-negative and sum to 1")
    u, rep, upto = hashed_unit(F.col(key), seed), F.lit(len(ratios)), 1.0
    for i in range(len(ratios) - 1, 0, -1):
        upto -= ratios[i]
        rep = F.when(u < upto, F.lit(i)).otherwise(rep)
    return df.withColumn("rep", rep)


def sample_repeats(df: DataFrame, key: str, n: int, repeats: int, seed: int = 0) -> DataFrame:
    """n rows without replacement in each of several repeats, by the rank of a hash."""
    reps = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep"))
    reps = reps.withColumn("_u", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("rep"), F.lit(seed))))
    return top_k(reps, ["rep"], [F.col("_u"), F.col(key)], n).drop("_u")


# --- Sets -------------------------------------------------------------------------------------------------------------


def union_tagged(tables: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in tables.items()])


def set_equal(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def membership_counts(df: DataFrame, key: str, group: str, groups: list[str]) -> DataFrame:
    """How many keys stand in exactly which of the groups."""
    flags = df.groupBy(key).agg(*[F.bool_or(F.col(group) == g).alias(f"in_{g}") for g in groups])
    flags = flags.withColumns({f"in_{g}": F.coalesce(f"in_{g}", F.lit(False)) for g in groups})
    return flags.groupBy(*[f"in_{g}" for g in groups]).agg(F.count(F.lit(1)).alias("n"))
