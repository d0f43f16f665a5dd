"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get global numbers 0..N-1 without a global sort: rows alike in id, size and checksum are counted as one group, whose
key is mixed into one of ``BUCKETS`` buckets; each bucket is numbered by a window ordered by that key, and the running sum
of the bucket counts is the offset of a bucket. The table of offsets has at most ``BUCKETS`` rows, whatever the input, so
it is broadcast. A null or repeated id is spread by its texts, and copies without number are one group until they are
written out, in stretches of ``STRETCH`` rows.

The permutation works on Z_a x Z_b with a = ceil(sqrt(N)) and b = ceil(N / a): odd rounds add a keyed mix of the right
half to the left one modulo a, even rounds the other way modulo b. a * b exceeds N by less than a, so fewer than one
row in sqrt(N) falls outside and walks on; the walk ends within a * b - N + 1 passes, which bounds its loop exactly.

Everything is SQL arithmetic below 2**63, so position, shard and slot of any row number can be computed anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.session import materialize

BUCKETS = 4096
ROUNDS = 6
#: Rows of one group that are written out together.
STRETCH = 16_384
PRIME = 2147483647


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Keys of the rounds, by a linear congruential rule from the seed."""
    keys, state = [], seed % PRIME + 1
    for _ in range(rounds):
        state = state * 48271 % PRIME
        keys.append(state)
    return keys


def mix_sql(value: str, key: str, div: str = "div") -> tuple[str, str]:
    """SQL of the two halves of the round function: ``first`` over ``value``; ``second`` over the column ``m``."""
    first = f"((({value}) + {key}) % {PRIME} * 48271) % {PRIME}"
    second = f"((m + (m {div} 32768) * 7919 + 12345) % {PRIME} * 69621) % {PRIME}"
    return first, second


def bucket_sql(key: str, size: str, crc: str, buckets: int = BUCKETS) -> str:
    """Bucket of a group's key, three integers."""
    return f"((((coalesce({key}, 0) % {PRIME} + {PRIME}) % {PRIME}) * 48271 + {size} % {PRIME} * 69621 + {crc}) % {PRIME} * 16807) % {PRIME} % {buckets}"


def permuted(df: DataFrame, row: str, total: str, out: str, seed: int = 20) -> DataFrame:
    """Add ``out``: the place of row number ``row`` (0 <= row < total) in the permutation of 0..total-1."""
    keep = df.columns
    keys = round_keys(seed)
    df = df.withColumn("_a", F.ceil(F.sqrt(F.col(total).cast("double"))).cast("long"))
    df = df.withColumn("_b", F.expr(f"({total} + _a - 1) div _a"))
    df = df.withColumns({"_l": F.expr(f"{row} % _a"), "_r": F.expr(f"{row} div _a")})
    for i, key in enumerate(keys):
        a, b, mod = ("_l", "_r", "_a") if i % 2 == 0 else ("_r", "_l", "_b")
        first, second = mix_sql(b, str(key))
        df = df.withColumn("m", F.expr(first)).withColumn(a, F.expr(f"({a} + {second}) % {mod}"))
    df = df.withColumn("_x", F.expr("_l + _a * _r"))
    # One element of the loop is one round; before each pass a value that is in range stops changing.
    listed = f"array({', '.join(map(str, keys))})"
    first, second = mix_sql("IF(i % 2 = 0, s.r, s.l)", f"element_at({listed}, CAST(i % {ROUNDS} + 1 AS INT))")
    mixed = second.replace("m", "q")
    step = (
        f"IF(i % {ROUNDS} = 0 AND s.l + _a * s.r < {total}, named_struct('l', s.l, 'r', s.r, 'd', true), "
        f"IF(s.d, s, element_at(transform(array({first}), q -> "
        f"IF(i % 2 = 0, named_struct('l', (s.l + {mixed}) % _a, 'r', s.r, 'd', false), "
        f"named_struct('l', s.l, 'r', (s.r + {mixed}) % _b, 'd', false))), 1)))"
    )
    walk = (
        f"aggregate(sequence(0L, (_a * _b - {total} + 1) * {ROUNDS} - 1), named_struct('l', _l, 'r', _r, 'd', false), "
        f"(s, i) -> {step}, s -> s.l + _a * s.r)"
    )
    return df.withColumn(out, F.expr(f"CASE WHEN _x < {total} THEN _x ELSE {walk} END")).select(*keep, out)


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row; counts of the shards differ by one at most (law ``rows``).

    Returns id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32, row_number (global), position (after
    the permutation), shard = position mod shards and slot = position div shards (gapless in each shard).

    Nulls: a null id is a key like any other and sorts first; a null text has size 1 and the checksum of nothing.
    Ties: rows alike in id, size and checksum are interchangeable; each still gets its own number. An empty table
    gives an empty result. Other columns of the input are not read, so clashing names do no harm. Texts are read once.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).cast("long").alias("_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    groups = keyed.groupBy("_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    groups = materialize(groups.withColumn("_bucket", F.expr(bucket_sql("_id", "size", "text_crc32"))), "groups")
    counts = groups.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"))
    inside = Window.partitionBy("_bucket").orderBy("_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = groups.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(offsets), "_bucket")
    numbered = numbered.withColumn("_first", F.col("_start") + F.col("_before")).withColumn("_end", F.col("_first") + F.col("_n"))
    # A large group is dealt out in stretches, so that no task writes it alone.
    stretches = numbered.select("*", F.explode(F.expr(f"sequence(_first, _end - 1, {STRETCH}L)")).alias("_at")).repartition("_at")
    numbered = stretches.select(F.col("_id").alias(id_col), "size", "text_crc32", "_total", F.explode(F.expr(f"sequence(_at, least(_at + {STRETCH}, _end) - 1)")).alias("row_number"))
    placed = permuted(numbered, "row_number", "_total", "position", seed)
    return placed.select(
        id_col, "size", "text_crc32", "row_number", "position",
        F.expr(f"CAST(position % {shards} AS INT)").alias("shard"), F.expr(f"position div {shards}").alias("slot"),
    )


def locate(row: int, total: int, shards: int = 16, seed: int = 20) -> tuple[int, int]:
    """Shard and slot of one row number without any table: the same permutation in plain Python."""
    a = 1
    while a * a < total:
        a += 1
    b = (total + a - 1) // a

    def mix(v: int, key: int) -> int:
        m = (v + key) % PRIME * 48271 % PRIME
        return (m + m // 32768 * 7919 + 12345) % PRIME * 69621 % PRIME

    x = row
    while True:
        left, right = x % a, x // a
        for i, key in enumerate(round_keys(seed)):
            if i % 2 == 0:
                left = (left + mix(right, key)) % a
            else:
                right = (right + mix(left, key)) % b
        x = left + a * right
        if x < total:
            return x % shards, x // shards
