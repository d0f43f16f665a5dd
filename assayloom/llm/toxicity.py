"""Toxicity by a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of a character 3-, 4- or 5-gram in the lower-cased text, where every non-letter counts
as one boundary mark. Its value is the log-count ratio of the n-gram between toxic and other training documents; a
logistic regression on those values gives the score. Only n-grams whose ratio is clearly off zero become features, so a
long clean document isn't carried over the threshold by its mere number of n-grams. All such n-grams of the sample are
features, counted exactly over all letters of all scripts.

The classifier is fitted on a bounded sample of labelled rows (``TRAIN_DOCS`` rows, a third of them toxic, and
``TRAIN_BYTES`` of text); scoring reads every whole text, in blocks, so that memory doesn't grow with a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.worker import map_arrow, parts

#: At most about so many labelled documents are fitted.
TRAIN_DOCS = 3600
#: Bytes of their texts, at most about (a class's first text counts whatever its size).
TRAIN_BYTES = 32_000_000
#: An n-gram is a feature from this absolute log-count ratio on.
LEAST_RATIO = 1.8
LEAST_DOCS = 3
LENGTHS = (3, 4, 5)
THRESHOLD = 0.7
BITS = 22
BLOCK = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Training texts whose n-grams are counted at a time.
COUNTED = 200


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 1."""
    return np.array([c if chr(c).isalpha() else 1 for c in range(0x110000)], np.uint32)


def symbols(text: str) -> np.ndarray:
    """Letters of the lower-cased text as code points, between boundary marks."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return letters()[points].astype(np.uint64)


def codes(marks: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit codes of all n-grams: a polynomial over at most five code points, its degree told by its last term."""
    have = marks
    for n in range(2, max(LENGTHS) + 1):
        have = have[:-1] * _STEP + marks[n - 1 :]
        if n in LENGTHS:
            yield have + np.uint64(n << 40)


def slot(code: np.ndarray) -> np.ndarray:
    return (code * _MIX) >> np.uint64(64 - BITS)


@dataclass
class Model:
    """Sorted n-gram codes with their weights (ratio times coefficient), and the bias."""

    code: np.ndarray
    weight: np.ndarray
    bias: float


def grams(text: str) -> np.ndarray:
    """Distinct codes of a text's n-grams."""
    return np.unique(np.concatenate(list(codes(symbols(text)))))


def places(code: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where in the sorted codes those found stand that are among them."""
    at = np.searchsorted(code, found)
    at[at == len(code)] = 0
    return at[code[at] == found]


def counted(sets: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their counts by class, added up."""
    uniq, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    return uniq, np.stack([np.bincount(inverse, weights=w, minlength=len(uniq)).astype(np.int32) for w in np.concatenate(counts, axis=1)])


def fit(texts: list[str], toxic: list[int], rounds: int = 250, penalty: float = 2e-4) -> Model:
    """Ratios and logistic regression. Without both classes the score is constant: the share of toxic rows."""
    y = np.array(toxic, float)
    none = np.zeros(0, np.uint64)
    if not 0 < y.sum() < len(y):
        return Model(none, np.zeros(0), 40.0 if y.sum() else -40.0)
    sizes = np.array([len(y) - y.sum(), y.sum()])
    uniq, counts = none, np.zeros((2, 0), np.int32)
    for at in range(0, len(texts), COUNTED):
        kept = [grams(t) for t in texts[at : at + COUNTED]]
        classes = [np.stack([np.full(len(k), 1 - t, np.int32), np.full(len(k), t, np.int32)]) for k, t in zip(kept, toxic[at : at + COUNTED], strict=True)]
        uniq, counts = counted([uniq, *kept], [counts, *classes])
    p = (counts + 1.0) / (sizes[:, None] + 2.0)
    r = np.log(p[1]) - np.log(p[0])
    chosen = np.flatnonzero((np.abs(r) >= LEAST_RATIO) & (counts.sum(axis=0) >= LEAST_DOCS))
    if not len(chosen):
        return Model(none, np.zeros(0), float(np.log(sizes[1] / sizes[0])))
    uniq, r = uniq[chosen], r[chosen]
    found = [places(uniq, grams(t)) for t in texts]
    doc, feature = np.repeat(np.arange(len(texts)), [len(f) for f in found]), np.concatenate(found)
    w, bias = np.full(len(chosen), 0.05), 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for k in range(1, rounds + 1):  # Adam over all rows
        z = np.bincount(doc, weights=(w * r)[feature], minlength=len(y)) + bias
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.append(np.bincount(feature, weights=g[doc], minlength=len(chosen)) * r / len(y) + penalty * w, g.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(uniq, w * r, float(bias))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.here = np.zeros(1 << BITS, bool)
        if len(model.code):
            self.here[slot(model.code)] = True

    def score(self, text: str | None) -> float:
        """0 to 1; null and empty texts get the score of no feature at all."""
        model, found = self.model, []
        if text and len(model.code):
            for start in range(0, len(text), BLOCK):
                marks = symbols(text[max(0, start - max(LENGTHS)) : start + BLOCK])
                for c in codes(marks):
                    found.append(places(model.code, c[self.here[slot(c)]]))
        z = model.bias + (model.weight[np.unique(np.concatenate(found))].sum() if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def held_out_expr(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text modulo 3 is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", size: int = TRAIN_BYTES) -> Model:
    """Fit on about ``bound`` labelled rows that are not held out, chosen by the hash of the id, a third of them toxic,
    with at most about ``size`` bytes of text.

    The chosen ids are at most about 1.2 times ``bound`` rows, so they are broadcast to the documents. Labels other than
    0 and 1, null ids and null texts aren't learnt from; an id that repeats counts each time; without both labels the
    score is constant.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out_expr(id_col))
    usable = usable.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic"))
    counts = {r[0]: r[1] for r in usable.groupBy("_toxic").count().collect()}
    want = {1: bound // 3, 0: bound - bound // 3}
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.when(F.col("_toxic") == 1, min(1.0, 1.2 * want[1] / max(1, counts.get(1, 0)))).otherwise(min(1.0, 1.2 * want[0] / max(1, counts.get(0, 0))))
    few = usable.withColumn("_place", place).where(F.col("_place") < share)
    first = Window.partitionBy("_toxic").orderBy("_place", "_id")
    ids = few.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= F.when(F.col("_toxic") == 1, want[1]).otherwise(want[0])).select("_id", "_toxic", "_place")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    rows = texts.join(F.broadcast(ids), "_id").select("_id", "_text", "_toxic", "_place")
    first = Window.partitionBy("_toxic").orderBy("_place", "_id", "_text")
    rows = rows.withColumn("_k", F.row_number().over(first)).withColumn("_bytes", F.sum(F.octet_length("_text")).over(first.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.when(F.col("_toxic") == 1, size // 3).otherwise(size - size // 3)
    rows = rows.where((F.col("_k") <= bound) & ((F.col("_bytes") <= share) | (F.col("_k") == 1))).select("_id", "_text", "_toxic").collect()
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    return fit([r[1] for r in rows], [r[2] for r in rows])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` to ``keep`` (the id by default).

    Null and empty texts get the score of a text without any feature. Repeated rows are scored alike; an empty table
    gives an empty result. Other columns are passed on only if in ``keep``; a ``score`` of the input is replaced.
    """
    keep = [c for c in (keep or [id_col]) if c != "score"]
    rows = docs.select(F.col(text_col), *keep).toDF(*[f"c{i}" for i in range(len(keep) + 1)])
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in parts(batches, 1000):
            scores = [scorer.score(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(scores, pa.float64())], schema.names)

    return map_arrow(rows, run, schema)
