"""Language identification by word-first backoff.

A word that the training sample knows is scored by its log frequency in each language. An unseen word falls back to its
character n-grams, longest first: the first length of which any n-gram is known gives the score (their mean), down to
single characters. A document's language has the largest sum over its words. A word is a run of letters with the marks
that belong to them; Han characters and kana, which are written without spaces, are words each.

The model is fitted on a bounded sample of labelled rows (``TRAIN_DOCS`` rows and ``TRAIN_BYTES`` of text, shared evenly by
the languages, of which the ``TRAIN_DOCS`` commonest are learnt); it holds all words and n-grams of that sample that occur
often enough to tell. Scoring reads every whole text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.worker import map_arrow, parts

#: At most about so many labelled documents are fitted, in all languages together, with so many bytes of text.
TRAIN_DOCS = 4000
TRAIN_BYTES = 24_000_000
#: Unseen words whose scores a worker remembers.
MEMO = 100_000
#: Characters read at a time, about.
BLOCK = 500_000
SPACE = re.compile(r"\s")
LENGTHS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Han characters and kana.
SINGLE = "\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"


@lru_cache(1)
def word_pattern() -> re.Pattern:
    """A single character, or a run of letters and the marks between and after them."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(marks), lambda x: x[1] - x[0])]
    joined = "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)
    return re.compile(f"[{SINGLE}]|[^\\W\\d_{SINGLE}]+(?:[{joined}]+[^\\W\\d_{SINGLE}]*)*")


def words_of(text: str) -> list[str]:
    found = word_pattern().findall(text.lower())
    return found if text.isascii() else [w for w in found if any(map(str.isalpha, w))]  # fractions and the like are no words


def blocks(text: str) -> Iterator[list[str]]:
    """The words in parts of a bounded size, so that a very long text doesn't become one list."""
    step, at = max(1, MEMO // 2), 0
    while at < len(text):
        end = len(text)
        if end > at + BLOCK and (space := SPACE.search(text, at + BLOCK)):
            end = space.start()
        words = words_of(text[at:end])
        yield from (words[i : i + step] for i in range(0, len(words), step))
        at = end


@dataclass
class Model:
    """Rows of log posteriors by language: of words first, then of n-grams."""

    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def fit(texts: list[str], langs: list[str]) -> Model:
    """Count words and n-grams by language; rows are log posteriors under equal priors, with add-half smoothing."""
    names = sorted(set(langs))
    if not names:
        return Model([])
    at = {x: i for i, x in enumerate(names)}
    words: dict[str, list[int]] = {}
    for text, lang in zip(texts, langs, strict=True):
        for word, n in Counter(words_of(text)).items():
            words.setdefault(word, [0] * len(names))[at[lang]] += n
    known = [w for w, c in words.items() if sum(c) >= 2]
    known.sort()
    grams: dict[str, list[int]] = {}
    for word, counts in words.items():
        for n in LENGTHS:
            for gram in grams_of(word, n):
                had = grams.setdefault(gram, [0] * len(names))
                for i, c in enumerate(counts):
                    had[i] += c
    kept = [g for g, c in grams.items() if sum(c) >= 3 and not g.isspace()]
    kept.sort()

    def posteriors(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        logs = np.log((counts + 0.5) / (totals + 1.0))
        top = logs.max(axis=1, keepdims=True)
        return logs - top - np.log(np.exp(logs - top).sum(axis=1, keepdims=True))

    shape = (-1, len(names))
    by_word = np.array([words[w] for w in known], float).reshape(shape)
    by_gram = np.array([grams[g] for g in kept], float).reshape(shape)
    rows = [posteriors(by_word, by_word.sum(axis=0))] if known else []
    sizes = np.array([len(g) for g in kept])
    by_size = np.zeros_like(by_gram)
    for n in LENGTHS:  # n-grams of one length share their total
        if (sizes == n).any():
            by_size[sizes == n] = posteriors(by_gram[sizes == n], by_gram[sizes == n].sum(axis=0))
    rows = np.concatenate([*rows, by_size])
    return Model(names, {w: i for i, w in enumerate(known)}, {g: len(known) + i for i, g in enumerate(kept)}, rows.astype(np.float32))


class Scorer:
    """Scores whole texts; remembers unseen words up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model, self.base = model, len(model.rows)
        self.rows = np.concatenate([model.rows, np.zeros((MEMO, len(model.langs)), np.float32)])
        self.index, self.memo = dict(model.words), []

    def learn(self, words: list[str]) -> None:
        """Remember the scores of unseen words; when there are too many, those remembered so far go."""
        if len(self.memo) + len(words) > len(self.rows) - self.base:
            for w in self.memo:
                del self.index[w]
            self.memo = []
        for w in words:
            place = self.base + len(self.memo)
            self.rows[place], self.index[w] = self.backoff(w), place
            self.memo.append(w)

    def backoff(self, word: str) -> np.ndarray:
        for n in LENGTHS:
            found = [r for g in grams_of(word, n) if (r := self.model.grams.get(g)) is not None]
            if found:
                return self.model.rows[found].mean(axis=0) if len(found) > 1 else self.model.rows[found[0]]
        return np.zeros(len(self.model.langs), np.float32)

    def score(self, text: str | None) -> tuple[str, float]:
        """The language and its posterior; ``und`` and 0 if the text is null or has no letter."""
        total, some = np.zeros(len(self.model.langs)), False
        for part in blocks(text or "") if self.model.langs else ():
            some = True
            places = list(map(self.index.get, part))
            if None in places:
                self.learn(list({w: None for w, p in zip(part, places, strict=True) if p is None}))
                places = list(map(self.index.get, part))
                if None in places:  # remembered before the others went
                    self.learn(list({w: None for w, p in zip(part, places, strict=True) if p is None}))
                    places = list(map(self.index.get, part))
            total += self.rows[places].sum(axis=0, dtype=np.float64)
        if not some:
            return UNKNOWN, 0.0
        best = int(total.argmax())
        return self.model.langs[best], float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def training_sample(docs: DataFrame, bound: int, id_col: str, text_col: str, lang_col: str, size: int = TRAIN_BYTES) -> tuple[list[str], list[str]]:
    """About ``bound`` labelled texts of about ``size`` bytes, as many of each language, chosen by the hash of the text.
    A language's first text counts whatever its size."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    counts = labelled.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_lang").limit(bound)
    counts = docs.sparkSession.createDataFrame([tuple(r) for r in counts.collect()], "_lang string, _n long")
    langs = counts.count()
    if not langs:
        return [], []
    each = max(1, bound // langs)
    place = F.pmod(F.xxhash64("_text"), F.lit(1 << 40)) / float(1 << 40)
    few = labelled.join(F.broadcast(counts), "_lang").withColumn("_place", place).where(F.col("_place") < 1.2 * each / F.col("_n"))
    first = Window.partitionBy("_lang").orderBy("_place", "_text")
    few = few.withColumn("_k", F.row_number().over(first)).withColumn("_bytes", F.sum(F.octet_length("_text")).over(first.rowsBetween(Window.unboundedPreceding, 0)))
    found = few.where((F.col("_k") <= each) & ((F.col("_bytes") <= size // langs) | (F.col("_k") == 1))).select("_text", "_lang").toArrow()
    return found.column("_text").to_pylist(), found.column("_lang").to_pylist()


def held_out_expr(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text modulo 4 is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (posterior, 0 to 1) to ``keep`` (the id by default).

    Null, empty and letterless texts: ``und`` with score 0. Repeated rows are scored alike. A table without labels
    gives ``und`` everywhere. Ties go to the language that sorts first. Other columns are passed on only if in ``keep``;
    ``lang_pred`` and ``score`` of the input are replaced.
    """
    keep = [c for c in (keep or [id_col]) if c not in ("lang_pred", "score")]
    found = predict(docs.select(F.col(text_col), *keep), model, text_col in keep)
    return found


def predict(rows: DataFrame, model: Model, own: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns after the first, which is the text, with language and posterior under the given names; if ``own``, the
    text is among the others too and isn't sent twice."""
    count = len(rows.columns)
    plain = rows.toDF(*[f"c{i}" for i in range(count)])
    text = rows.columns.index(rows.columns[0], 1) if own else 0
    schema = plain.drop("c0").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)  # of this task: quickly made, and nothing stays in the worker
        for part in parts(batches, 1000):
            found = [scorer.score(t) for t in part.column(text - 1 if own else 0).to_pylist()]
            columns = part.columns if own else part.columns[1:]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema.names)

    out = map_arrow(plain.drop("c0") if own else plain, run, schema)
    return out.toDF(*rows.columns[1:], *names)


def train(docs: DataFrame, bound: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the rows that are not held out and have a text and a language; repeated rows count once or more, as the sample
    takes them. Without any such row the model knows no language. An empty text teaches nothing."""
    return fit(*training_sample(docs.where(~held_out_expr(id_col)), bound, id_col, text_col, lang_col))
