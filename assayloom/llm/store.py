"""Content-addressed store of token ids.

A document's ids are cut into chunks where a rolling hash of the last 16 ids has its top bits clear (64 to 4096 ids, about
576 in the mean), so equal passages give equal chunks wherever they stand. A chunk is stored once, under the BLAKE2b
digest of its bytes. A document is a recipe: the digests of its chunks in order, and the root of their Merkle tree. A
manifest holds, for every part of the recipes, the Merkle root over its documents.

Files (Parquet, in the folder given):

* ``blobs/kind=chunk``: key = digest, data = ids as little-endian integers of ``width`` bytes; one row per unique chunk;
* ``recipes``: in ascending order of the id: doc_id, n_tokens, root, recipe (digests, 16 bytes each), part, k (order);
* ``manifest``: part, n_docs, n_tokens, root.

Texts are read and encoded once; ids travel through one shuffle, by digest, after each task has dropped the chunks it has
sent before. Reading back verifies every chunk against its digest, every document against its Merkle root and every part
against the manifest, and raises if one differs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.llm.tokens import encoder
from assayloom.llm.worker import map_arrow, parts, record, tidy
from assayloom.session import materialize

WINDOW, CUT_BITS = 16, 9
MIN_CHUNK, MAX_CHUNK = 64, 4096
DIGEST = 16
#: Digests that a task remembers so as not to send a chunk twice.
SEEN = 400_000
FANOUT = 1024
END = 1


@lru_cache(1)
def gear() -> np.ndarray:
    """A 64-bit word for each id modulo 65536, by the splitmix rule."""
    x = np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    h = gear()[ids & 0xFFFF]
    k = 1
    while k < WINDOW and k < len(h):
        more = h.copy()
        more[k:] += h[:-k] << np.uint64(k)
        h, k = more, 2 * k
    ends, last = [], 0
    for c in (np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 1).tolist():
        if c - last < MIN_CHUNK:
            continue
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if c - last >= MIN_CHUNK:
            ends.append(c)
            last = c
    while len(ids) - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < len(ids):
        ends.append(len(ids))
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree; an odd last node moves up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def part_roots(recipes: DataFrame) -> DataFrame:
    """Merkle roots over the documents of each part, by levels of ``FANOUT``: no group is larger."""
    level = recipes.select("part", F.pmod("k", F.lit(1 << 33)).alias("i"), F.lower(F.hex("root")).alias("root"), "n_tokens", F.lit(1).cast("long").alias("n_docs"))
    for last in (False, False, True):
        keys = [F.col("part")] if last else [F.col("part"), F.expr(f"i div {FANOUT}").alias("i")]
        level = level.groupBy(*keys).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "root"))), lambda s: s["root"]), ","), 256).alias("root"),
            F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs"),
        )
    return level


def write_store(docs: DataFrame, path: str, tokenizer: str, style: str, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append id 1 and write the store.

    Repeated rows are kept, each with its recipe; null ids sort first. ``width`` is 2 where all ids are below 65536,
    else 4. An empty table gives an empty store. Other columns aren't read.
    """
    kind = np.dtype(f"<u{width}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer, style), set()
        for part in parts(batches, 256):
            out: list[tuple] = []
            for doc, ids in zip(part.column(0).to_pylist(), encode.encode(part.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(END))
                data, last, names = ids.astype(kind).tobytes(), 0, []
                for end in cuts(ids):
                    chunk = data[last * width : end * width]
                    names.append(name := digest(chunk))
                    last = end
                    if name not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        out.append(("chunk", name, chunk, None, None, None))
                recipe = b"".join(names)
                out.append(("recipe", digest(f"{doc}:".encode() + recipe), recipe, doc, len(ids), merkle(names)))
            kinds, keys, datas, docs_, sizes, roots = (list(x) for x in zip(*out, strict=True))
            yield record(kind=(kinds, "string"), key=(keys, "binary"), data=(datas, "binary"), doc_id=(docs_, "int64"), n_tokens=(sizes, "int64"), root=(roots, "binary"))

    schema = "kind string, key binary, data binary, doc_id long, n_tokens long, root binary"
    blobs = map_arrow(rows, run, schema).groupBy("kind", "key").agg(
        F.first("data").alias("data"), F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.count(F.lit(1)).alias("copies"),
    )
    blobs.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/blobs")
    spark = docs.sparkSession
    blobs = spark.read.schema(f"{schema}, copies long").parquet(f"{path}/blobs")
    recipes = blobs.where("kind = 'recipe'").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = [F.col("doc_id").asc_nulls_first(), F.col("key"), F.col("_copy")]  # many rows alike don't meet in one part
    recipes = recipes.repartitionByRange(*order).sortWithinPartitions(*order)
    recipes.select("doc_id", "n_tokens", "root", F.col("data").alias("recipe"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("k")).write.parquet(f"{path}/recipes")
    part_roots(read_recipes(spark, path)).write.parquet(f"{path}/manifest")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, root binary, recipe binary, part int, k long").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Unique chunks: key, data."""
    return spark.read.schema("key binary, data binary, kind string").parquet(f"{path}/blobs").where("kind = 'chunk'").select("key", "data")


def recipe_steps(recipes: DataFrame) -> DataFrame:
    """One row per chunk of a document: k, i (order), key."""
    steps = recipes.select("k", F.posexplode(F.expr(f"transform(sequence(0, length(recipe) div {DIGEST} - 1), j -> substring(recipe, j * {DIGEST} + 1, {DIGEST}))")).alias("i", "key"))
    return steps


def read_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """The documents' ids from the files: doc_id, n_tokens, ids (array of long), a row for each row written. A null or
    empty text has the end id alone; an empty store gives none."""
    steps = recipe_steps(read_recipes(spark, path)).join(read_chunks(spark, path), "key")
    whole = steps.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "data"))).alias("parts"))
    joined = read_recipes(spark, path).join(whole, "k").select("doc_id", "n_tokens", F.expr("transform(parts, p -> p.data)").alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 256):
            ids = [np.frombuffer(b"".join(p), f"<u{width}").astype(np.int64) for p in b.column(2).to_pylist()]
            yield record(doc_id=b.column(0), n_tokens=b.column(1), ids=pa.array(ids, pa.list_(pa.int64())))

    return map_arrow(joined, run, "doc_id long, n_tokens long, ids array<long>")


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, reflected bits."""
    out = 0
    for i in range(32):
        if a >> (31 - i) & 1:
            out ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(64)
def shift_table(k: int) -> tuple[list[int], ...]:
    """Tables that carry a CRC-32 over 2**k further bytes, one for each byte of it."""
    power = 1 << 23  # x ** 8
    for _ in range(k):
        power = _times(power, power)
    bits = [_times(power, 1 << i) for i in range(32)]
    tables = []
    for j in range(4):
        t = [0]
        for i in range(8):
            t += [x ^ bits[8 * j + i] for x in t]
        tables.append(t)
    return tuple(tables)


def crc32_join(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two strings put together, from theirs."""
    k = 0
    while second_bytes:
        if second_bytes & 1:
            a, b, c, d = shift_table(k)
            first = a[first & 255] ^ b[first >> 8 & 255] ^ c[first >> 16 & 255] ^ d[first >> 24]
        second_bytes, k = second_bytes >> 1, k + 1
    return first ^ second


def read_digests(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Read the store back and verify it: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned,
    over all its ids as little-endian unsigned 32-bit integers), n_chunks.

    The ids of a chunk are decoded and checked once, however many documents hold it; what travels to the documents is
    the chunk's length and checksum, and a document's checksum is joined from those of its chunks.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            crc, n = [], []
            for key, data in zip(b["key"], b["data"], strict=True):
                if digest(data) != bytes(key):
                    raise ValueError(f"a chunk differs from its digest {bytes(key).hex()}")
                ids = np.frombuffer(data, f"<u{width}").astype("<u4")
                crc.append(zlib.crc32(ids.tobytes()))
                n.append(len(ids))
            yield pd.DataFrame({"key": b["key"], "n": n, "crc": crc})

    chunks = read_chunks(spark, path).mapInPandas(tidy(check), "key binary, n long, crc long")
    recipes = read_recipes(spark, path)
    steps = recipe_steps(recipes).join(chunks, "key").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "n", "crc", "key"))).alias("parts"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            crcs, sizes, roots = [], [], []
            for parts in b["parts"]:
                crc, size = 0, 0
                for p in parts:
                    crc = crc32_join(crc, p["crc"], 4 * p["n"])
                    size += p["n"]
                crcs.append(crc)
                sizes.append(size)
                roots.append(merkle([bytes(p["key"]) for p in parts]))
            yield pd.DataFrame({"k": b["k"], "ids_crc32": crcs, "found": sizes, "n_chunks": b["parts"].map(len), "root": roots})

    built = steps.mapInPandas(tidy(build), "k long, ids_crc32 long, found long, n_chunks int, root binary")
    sums = recipes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row per part of the files
    upto = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select("doc_id", "n_tokens", "part", "k", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)).alias("_in"), F.col("root").alias("_root"))
    placed = placed.join(sums, "part").join(built, "k", "left")
    wrong = F.col("root").isNull() | (F.col("root") != F.col("_root")) | (F.col("found") != F.col("n_tokens"))
    placed = placed.withColumn("root", F.when(wrong, F.raise_error(F.lit("a document differs from its recipe"))).otherwise(F.col("root")))
    placed = materialize(placed.select("doc_id", (F.col("_start") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32", "n_chunks", "part", "k", "root"), "read-back")
    manifest = spark.read.schema("part int, root string, n_tokens long, n_docs long").parquet(f"{path}/manifest")
    other = part_roots(placed).join(manifest.withColumnsRenamed({"root": "_root", "n_docs": "_docs"}).drop("n_tokens"), "part", "full").where("root <=> _root AND n_docs <=> _docs")
    if other.count() != manifest.count():
        raise ValueError("the documents read back differ from the manifest")
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks")
