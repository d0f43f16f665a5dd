"""Near duplicates by one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

0. Every row gets a running number, written once with its words (A-Z lower-cased, one space between them) and signature;
   all that follows reads that table, never the documents again. Rows of equal words share one representative.
1. Every whole text becomes its set of distinct word shingles (64-bit hashes).
2. One permutation, ``BANDS * ROWS`` bins: a bin's value is the least hash in its range; an empty bin takes the value of
   the full bin that ranks first in its own random order (a consistent choice, so similar sets choose alike).
3. ``ROWS`` bins make a band; documents with an equal band share a bucket. Sets of similarity 0.75 share none of the 48
   bands with a probability below 3 in a million.
4. Stars: each document is compared with one hub, namely that which it shares most bands with. The hub of a bucket is its
   member that meets most others in all its buckets, which is the original of a group of copies of it, wherever it
   stands. Confirmed links give components; rows that share an id are linked as well.
5. What is left are pairs in one bucket but in different components. The members of such buckets are joined exactly by
   prefixes: with each set's shingles ordered rarest first (by their count among these members), two sets that are
   similar enough share one early in both, where enough of both is still to come. Those outside the commonest component
   of a bucket look for partners of each size class only as far as that class allows. So no colliding pair that could
   be a link goes unexamined, while a large group of loose copies doesn't give all its pairs.
6. Links are confirmed on the full sets, as words, not as hashes: 100 * intersection >= 75 * union. Components by repeated
   least-neighbour stars, down to a bounded number of edges.

Nothing grows in the driver: rows, links and components stay in tables, cut from their lineage in the shared folder, and
the driver joins up at most ``MOST_EDGES`` edges. That saves most of the jobs, whose plans and tasks fill its memory.
Numbers of rows whose texts are wanted again are broadcast only up to
``BROADCAST_ROWS`` of them (counted), and shuffled beyond that; other joins leave it to Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm import shingles
from assayloom.llm.worker import map_arrow, parts, record
from assayloom.session import materialize

WORDS = 5
#: Percent of the union that the intersection must reach.
PERCENT = 75
BANDS, ROWS = 48, 5
#: Row numbers that are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000
#: Edges that the driver joins up itself, in a few arrays; a larger graph goes through rounds of stars until so many are left.
MOST_EDGES = 200_000


@lru_cache(1)
def ranks() -> np.ndarray:
    """Of each bin (row), the random order in which it looks for a full bin."""
    k = BANDS * ROWS
    return shingles.mix(np.arange(k * k, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)).reshape(k, k)


@lru_cache(1)
def bounds() -> np.ndarray:
    k = BANDS * ROWS
    return np.array([(i << 64) // k for i in range(k)], np.uint64)


def signature(sorted_set: np.ndarray) -> np.ndarray:
    """Values of the bins; the set is sorted and not empty."""
    edges = bounds()
    at = np.searchsorted(sorted_set, edges)
    ends = np.append(at[1:], len(sorted_set))
    full = at < ends
    out = sorted_set[np.minimum(at, len(sorted_set) - 1)]
    if not full.all():
        have, empty = np.flatnonzero(full), np.flatnonzero(~full)
        out[empty] = out[have[ranks()[np.ix_(empty, have)].argmin(axis=1)]]
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different for equal values in different bands."""
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = shingles.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (running number), id, n (size of the set), digest (of the words), words, bands; no bands for an empty set."""
    rows = docs.select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 500):
            sizes, digests, words, bands = [], [], [], []
            for data in part.column(2).to_pylist():
                words.append(plain := shingles.plain_words(data))
                found = shingles.shingle_set(plain, WORDS)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(plain, digest_size=16).digest())
                bands.append(band_keys(signature(found)) if len(found) else None)
            yield record(
                row=part.column(0), id=part.column(1), n=(sizes, "int64"), digest=(digests, "binary"), words=(words, "binary"), bands=pa.array(bands, pa.list_(pa.int64())),
            )

    return map_arrow(rows, run, "row long, id long, n long, digest binary, words binary, bands array<long>")


def similar_sizes(a: str, b: str):
    """The larger set isn't too large for the smaller one."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def shingle_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, shingles (hashes) of the wanted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 500):
            sets = [shingles.shingle_set(d, WORDS).view(np.int64) for d in part.column(1).to_pylist()]
            yield record(row=part.column(0), shingles=pa.array(sets, pa.list_(pa.int64())))

    return map_arrow(only(texts.select("row", "words"), wanted), run, "row long, shingles array<long>")


def only(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of some rows: these are broadcast up to a counted bound, so that no other text is shuffled; more are
    shuffled with the texts."""
    rows = rows.distinct()
    return texts.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "row", "left_semi")


def size_class(n: str) -> str:
    """SQL of the size class of a set: steps of about five percent."""
    return f"CAST(floor(20 * ln({n})) AS INT)"


def prefix_pairs(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members with different labels that may be similar enough, one of each a stray; exact: every pair
    that is similar enough is among them.

    members: row, label, stray. Two sets of sizes n and m need o = ceil(75 * (n + m) / 175) common shingles; so their
    first common shingle, at places i and j, has i <= n - o and j <= m - o. A stray's shingle at place i can be that
    only for partners with m <= 175 * (n - i) / 75 - n, which bounds the size classes it is sent to.
    """
    need = 100 + PERCENT
    each = materialize(shingle_sets(texts, members.select("row")).select("row", F.explode("shingles").alias("s")), "shingles")
    counts = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(counts, "s").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("all"))
    ordered = ordered.join(members.select("row", "label", "stray"), "row").withColumn("n", F.size("all"))
    placed = ordered.select("row", "n", "label", "stray", F.posexplode(F.expr(f"slice(all, 1, n - CAST(ceil(n * {PERCENT} / 100D) AS INT) + 1)")).alias("i", "x"))
    placed = placed.where("x.df > 1").select("row", "n", "label", "stray", "i", F.col("x.s").alias("s"))
    placed = materialize(placed, "prefixes")
    top = f"{need} * (n - i) / {PERCENT}D - n + 0.001"
    seek = placed.where(f"stray AND {top} >= 1").select(
        "s", F.explode(F.expr(f"sequence({size_class(f'greatest(n * {PERCENT - 1} / 100D, 1D)')}, greatest({size_class(f'least({top}, n * 100 / {PERCENT - 1}D)')}, {size_class(f'greatest(n * {PERCENT - 1} / 100D, 1D)')}))")).alias("class"),
        F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"), F.col("i").alias("i_a"),
    )
    offer = placed.select("s", F.expr(size_class("n")).alias("class"), F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"), F.col("i").alias("i_b"))
    both = seek.join(offer, ["s", "class"]).where((F.col("label_a") != F.col("label_b")) & similar_sizes("n_a", "n_b"))
    both = both.where(F.expr(f"{need} * least(n_a - i_a, n_b - i_b) >= {PERCENT} * (n_a + n_b)"))
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def confirm(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b), a written table, those whose full sets are similar enough, compared as words."""
    words = only(texts.select("row", "words"), pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))))
    both = pairs.join(words.withColumnsRenamed({"row": "a", "words": "x"}), "a").join(words.withColumnsRenamed({"row": "b", "words": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 500):
            found = (shingles.common_and_union(x, y, WORDS) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
            yield record(a=part.column(0), b=part.column(1)).filter(pa.array([100 * common >= PERCENT * union for common, union in found], pa.bool_()))

    return map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long")


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the least node that each reaches: the ends of each edge point to the lesser of their
    labels, and pointers are followed to their ends, until nothing moves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        new, least = label.copy(), np.minimum(label[x], label[y])
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while not np.array_equal(ends := new[new], new):
            new = ends
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def joined(edges: DataFrame, u: str, v: str) -> DataFrame:
    """node, label of a written table of few edges, joined up in the driver."""
    found = edges.select(F.col(u).cast("long"), F.col(v).cast("long")).toArrow()
    nodes, labels = least_reachable(*(c.to_numpy() for c in found.columns))
    return materialize(edges.sparkSession.createDataFrame(pa.table({"node": nodes, "label": labels})), "labels")


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """A table of node, label (least node reachable), for every node of an edge (a written table, of longs). More than ``MOST_EDGES``
    go through alternating large and small stars first.

    A node's least neighbour is a partial aggregate and comes back by a join that can be split, so a node with very many
    neighbours doesn't land in one task. Every round is written to the shared folder.
    """
    edges = edges.where(F.col(u) != F.col(v))
    if edges.count() <= MOST_EDGES:
        return joined(edges, u, v)
    edges = materialize(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = materialize(small.where("u <> v").distinct(), "edges")
        # Done when every node has one edge and no node stands on both sides: then all are stars around the least.
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state.n <= MOST_EDGES:
            return joined(edges, "u", "v")
        if state == seen:
            ends = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(ends), "labels")
        seen = state


def labelled(frame: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``label`` to rows: the component, or the row itself."""
    return frame.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every row: id, n_shingles, component_id (least id reachable, its own included), kept.

    Words are cut at the space and 0x09 to 0x0D, A-Z lower-cased; a text with fewer than five words has its whole
    sequence as its one shingle; null, empty and blank texts have none and are linked with nothing. Rows that repeat an
    id are one document: those with shingles share a component. A row without an id is linked like any other, but is
    never a component's id: its component_id is null, and it is kept, only if its component has no id at all. An empty
    table gives an empty result; other columns aren't read.
    """
    rows = materialize(signatures(docs, id_col, text_col), "signatures")
    full = rows.where("n > 0").select("row", "id", "n", "digest", "bands")
    reps = full.groupBy("digest").agg(F.min(F.struct("row", "n", "bands")).alias("rep"), F.min("id").alias("id"))
    reps = materialize(reps.select("digest", "rep.row", "rep.n", "rep.bands", "id"), "representatives")
    # Rows of one id with other words: each representative is linked to the least one of the id.
    repeated = full.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("_rows"), F.min("digest").alias("least"), F.max("digest").alias("most"))
    repeated = repeated.where("_rows > 1 AND least <> most").select("id", "least")
    same_id = full.select("id", "digest").join(repeated, "id").where("digest <> least").select("digest", "least").distinct()
    number = reps.select("digest", F.col("row").alias("a"))
    same_id = same_id.join(number, "digest").select("a", F.col("least").alias("digest")).join(number.withColumnRenamed("a", "b"), "digest").select("a", "b")

    keys = reps.select(F.explode("bands").alias("key"), "row", "n")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(keys.join(sizes, "key"), "shared")
    met = shared.groupBy("row").agg(F.sum("size").alias("_met"))
    hubs = shared.join(met, "row").groupBy("key").agg(F.max(F.struct("_met", (-F.col("row")).alias("_neg"), "n")).alias("hub"))
    buckets = materialize(shared.join(hubs, "key").select("key", "row", "n", (-F.col("hub._neg")).alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")

    stars = buckets.where((F.col("row") != F.col("hub")) & similar_sizes("n", "hub_n")).groupBy("row", "hub").agg(F.count(F.lit(1)).alias("_shared"))
    stars = stars.groupBy("row").agg(F.max(F.struct("_shared", (-F.col("hub")).alias("_neg"))).alias("best"))
    stars = materialize(stars.select(F.col("row").alias("a"), (-F.col("best._neg")).alias("b")), "stars")
    links = materialize(confirm(rows, stars).unionByName(same_id), "links")

    members = materialize(labelled(buckets.select("key", "row"), components(links)), "members")
    mixed = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_size")).groupBy("key").agg(F.count(F.lit(1)).alias("_labels"), F.max(F.struct("_size", "label")).alias("_top")).where("_labels > 1")
    inside = members.join(mixed.select("key", F.col("_top.label").alias("_main")), "key")
    inside = inside.groupBy("row").agg(F.first("label").alias("label"), F.max(F.col("label") != F.col("_main")).alias("stray"))
    pairs = prefix_pairs(rows, materialize(inside, "inside"))
    known = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = materialize(pairs.join(known, ["a", "b"], "left_anti"), "pairs")

    more = materialize(confirm(rows, pairs), "more-links")
    labels = components(links.unionByName(more))
    # Written first, so that the join below is between two shuffles and a digest of very many copies can be split.
    of = labelled(reps.select("digest", "row", "id"), labels)
    least = of.groupBy("label").agg(F.min("id").alias("_component"))
    classes = materialize(of.join(least, "label").select("digest", "_component"), "classes")
    out = rows.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(classes, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
