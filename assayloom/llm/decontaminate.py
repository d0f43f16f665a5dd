"""Benchmark decontamination by template canonicalisation.

A text becomes a row of tokens in which numbers, units (after a number) and names are typed placeholders and all other
words are lower-cased without outer punctuation; a run of numbers or of names is one placeholder. Two readings are
indexed: names are the words capitalised inside a sentence, or all capitalised words; beside them the lower-cased words
themselves, whatever share of them are numbers and names, so that exact copies are always found. Windows of ``WINDOW``
tokens (for items of under ``LONG`` also of about a third of the item) of a benchmark item and of a document that are
equal as templates are matches, whatever stands in the slots. On each diagonal
(document place minus item place) the slots of the matched stretch are compared: a question that was only given other
numbers or names maps each slot value to one value, and no two to the same; what breaks that in more than a fifth of its
slots is no leak. A document leaks an item if what matches on a diagonal, or on all diagonals within a quarter of the item
(words put in or left out), covers at least ``COVER`` of the item's tokens, and no fewer than ``least_tokens``.

Candidates come from a hash join in Spark: the windows of all distinct items are a table; a pass over the documents
gives their windows that pass a filter of ``FILTER_BITS`` bits (a Bloom filter with two probes, of a fixed size, so that it
may be sent to every task; a larger benchmark only lets more through), and both are joined by hash. A document and an item
whose common windows could cover enough of the item are a candidate, and only those are compared word by word. Texts are
told apart by 16 bytes of their SHA-256, so copies are compared once.
"""

from __future__ import annotations

import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.shingles import mix, piece_hashes
from assayloom.llm.worker import map_arrow, parts, record
from assayloom.session import materialize

WINDOW = 8
#: Words in a window that aren't placeholders, at least (or all words of a shorter item).
LEAST_WORDS = 4
COVER = 0.5
#: Items of fewer tokens have shorter windows too, as long as the piece that two changed words leave somewhere.
LONG, LEAST_WINDOW = 26, 3
LEAST_CONSISTENT = 0.8
#: Bits of the filter of window hashes, as a power of two.
FILTER_BITS = 25
#: Words that a task remembers: such as aren't read in arrays.
MEMO = 200_000
BITS = 20
#: Words of a text handled at a time; parts overlap by the longest item.
PART = 400_000
#: Words of short texts handled together, about.
TOGETHER = 40_000

# Fixed values of the canonical forms.
UNITS = frozenset("mm cm m km mg g kg t ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years inch inches ft foot feet yard yards mile miles oz lb lbs pound pounds mph kmh percent degree degrees dollar dollars euro euros cent cents usd eur gb mb kb tb hz khz mhz ghz w kw mw v mv a ma".split())
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%|[$€£])?")
OUTER = re.compile(r"^[^\w$€£+-]+|[^\w%$€£]+$")
IS_NUMBER, IS_UNIT, IS_CAPITAL, ENDS, IS_EMPTY = 1, 2, 4, 8, 16
#: The reading without placeholders.
LITERAL = 2
#: Words that no text has (they are white space), before a text and before a part that goes on inside a sentence: no window spans them.
BEFORE, BEFORE_INSIDE = "\x1e", "\x1f"
SLOTS = {name: xxhash.xxh64_intdigest(f"<{name}>") for name in ("number", "unit", "name")}


def byte_table(test: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(test.encode())] = True
    return out


LOWER, UPPER = (byte_table(x) for x in (string.ascii_lowercase, string.ascii_uppercase))
LETTER, STOP = LOWER | UPPER, byte_table(".!?:")
#: What goes from the end of a word.
MARK = byte_table("".join(c for c in string.punctuation if c not in "_%$"))


def hashes_of(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return piece_hashes(b"".join([*words, bytes(8)]), np.append(0, ends[:-1]), ends) if words else np.zeros(0, np.uint64)


class Lexicon(dict):
    """Hashes of the bare forms of words, and flags. Words of Latin letters (up to U+00FF), with a mark at the end or
    without, are read in arrays; of others the number is remembered."""

    def __init__(self) -> None:
        super().__init__()
        self.forget()
        self.numbers, self.units = (np.sort(hashes_of([w.encode() for w in of if w.isalpha()])) for of in (NUMBER_WORDS, UNITS))

    def forget(self) -> None:
        self.clear()
        self.waiting: list[tuple[bytes, int]] = []
        self.hashes, self.flags = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint8)

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.waiting.append(self.read(word))
        return place

    def read(self, word: str) -> tuple[bytes, int]:
        """Bare form in lower case, and flags."""
        if word in (BEFORE, BEFORE_INSIDE):
            return word.encode(), ENDS if word == BEFORE else 0
        bare = word if word.isalpha() else OUTER.sub("", word)
        low = bare.lower()
        flag = ENDS if word.rstrip("\"')]}»”’")[-1:] in ".!?:" else 0
        if not any(map(str.isalnum, bare)):
            flag |= IS_EMPTY
        elif low in NUMBER_WORDS or (not bare.isalpha() and NUMBER.fullmatch(bare)):
            flag |= IS_NUMBER
        elif low in UNITS:
            flag |= IS_UNIT
        if bare[:1].isupper() and not bare.isupper():
            flag |= IS_CAPITAL
        return low.encode("utf-8", "surrogatepass"), flag

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and flags of each word, and its place; words without letter or digit are left out."""
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
        data = " ".join(words).encode("utf-8", "surrogatepass")
        view = np.frombuffer(data, np.uint8)
        spaces = np.flatnonzero(view == 32)
        starts, ends = np.append(0, spaces + 1), np.append(spaces, len(view))
        letter, upper, low = LETTER[view], UPPER[view], data.lower()
        wide = np.flatnonzero(view == 0xC3)  # first bytes of U+00C0 to U+00FF
        wide = wide[(view[wide + 1] != 0x97) & (view[wide + 1] != 0xB7)]  # but for the signs of multiplication and division
        if len(wide):
            capital = wide[view[wide + 1] < 0x9F]
            letter[wide] = letter[wide + 1] = upper[capital] = True
            lowered = np.frombuffer(low, np.uint8).copy()
            lowered[capital + 1] += 0x20
            low = lowered.tobytes()
        count = lambda flags: np.append(np.int64(0), np.cumsum(flags))
        upto, uppers = count(letter), count(upper)
        letters, uppers = upto[ends] - upto[starts], uppers[ends] - uppers[starts]
        size, last = ends - starts, view[ends - 1]
        marked = (letters == size - 1) & (size > 1) & MARK[last]
        token = piece_hashes(low + bytes(8), starts, ends - marked)
        flag = np.where(marked & STOP[last], ENDS, 0).astype(np.uint8)
        flag[upper[starts] & (uppers < letters - (np.searchsorted(wide, ends) - np.searchsorted(wide, starts)))] |= IS_CAPITAL
        number = among(token, self.numbers)
        flag[number] |= IS_NUMBER
        flag[among(token, self.units) & ~number] |= IS_UNIT
        odd = np.flatnonzero(~marked & (letters != size))
        if len(odd):
            if len(self) > MEMO:
                self.forget()
            places = np.fromiter((self[words[i]] for i in odd.tolist()), np.int64, len(odd))
            if self.waiting:
                first = len(self) - len(self.waiting)
                while len(self.hashes) < len(self):
                    self.hashes, self.flags = np.concatenate([self.hashes, self.hashes]), np.concatenate([self.flags, self.flags])
                self.hashes[first : len(self)] = hashes_of([w for w, _ in self.waiting])
                self.flags[first : len(self)] = [f for _, f in self.waiting]
                self.waiting = []
            token[odd], flag[odd] = self.hashes[places], self.flags[places]
        at = np.flatnonzero(flag & IS_EMPTY == 0)
        return token[at], flag[at], at


def among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Whether each value is one of a few sorted ones."""
    return few[np.minimum(np.searchsorted(few, values), len(few) - 1)] == values


@dataclass
class Reading:
    """Tokens of one reading: hashes, whether each is a placeholder, and the first word of each (and the end)."""

    token: np.ndarray
    slot: np.ndarray
    start: np.ndarray


def readings(token: np.ndarray, flag: np.ndarray) -> list[Reading]:
    """Names inside sentences; all capitalised words as names; the words as they are, with the first one's placeholders marked."""
    number, ends = flag & IS_NUMBER > 0, flag & ENDS > 0
    after = np.zeros(len(flag), bool)
    after[1:] = number[:-1]
    unit = (flag & IS_UNIT > 0) & after & ~number
    capital = (flag & IS_CAPITAL > 0) & ~number & ~unit
    opens = np.ones(len(flag), bool)
    opens[1:] = ends[:-1]
    out = []
    for name in (capital & ~opens, capital):
        typed = token.copy()
        typed[number], typed[unit], typed[name] = SLOTS["number"], SLOTS["unit"], SLOTS["name"]
        first = np.ones(len(flag), bool)
        first[1:] = ends[:-1] | ~((number[1:] & number[:-1]) | (name[1:] & name[:-1]))
        start = np.flatnonzero(first)
        out.append(Reading(typed[start], (number | unit | name)[start], np.append(start, len(flag))))
    return [*out, Reading(token, number | unit | (capital & ~opens), np.arange(len(flag) + 1))]


class Runs:
    """Hashes of the windows of a row of tokens, from those of half the width."""

    def __init__(self, token: np.ndarray) -> None:
        self.by = {1: token}

    def of(self, n: int) -> np.ndarray:
        if n not in self.by:
            half = 1 << ((n - 1).bit_length() - 1)
            a = self.of(half)
            self.by[n] = mix(a[: len(a) - (n - half)] * np.uint64(0x9E3779B97F4A7C15) + a[n - half :] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)) if len(a) > n - half else a[:0]
        return self.by[n]


def salted(found: np.ndarray, reading: int, n: int) -> np.ndarray:
    """Windows of another reading or width have other hashes; bijective, and spread by the product."""
    return (found ^ np.uint64(reading * 64 + n)) * np.uint64(0xA0761D6478BD642F)


@dataclass
class Item:
    item_id: Any
    words: list[str]
    readings: list[Reading]


def least_tokens(size: int) -> int:
    """Tokens that a leak of an item of so many tokens has: all of a short one's, a window of a long one's."""
    return size if size < WINDOW else min(WINDOW, -(-3 * size // 4))


def bare(word: str) -> str:
    return OUTER.sub("", word).lower()


def value(words: list[str]) -> str:
    return " ".join(map(bare, words))


def item_of(item_id: Any, text: str, lexicon: Lexicon) -> Item | None:
    """Words and readings of an item; none if it has no word."""
    words = text.split()
    token, flag, at = lexicon.tokens(words)
    return Item(item_id, [words[i] for i in at.tolist()], readings(token, flag)) if len(token) else None


def item_windows(item: Item) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Reading, width, hashes and places of the windows of an item."""
    for r, reading in enumerate(item.readings):
        runs = Runs(reading.token)
        for n, least in widths(r, len(reading.token)):
            keep = np.flatnonzero(np.convolve(~reading.slot, np.ones(n, int), "valid") >= least)
            yield r, n, salted(runs.of(n)[keep], r, n), keep


def widths(reading: int, size: int) -> list[tuple[int, int]]:
    """Widths of the windows of an item of so many tokens, and the words each must have that aren't placeholders."""
    n = min(WINDOW, size)
    out = [(n, 0 if reading == LITERAL else min(LEAST_WORDS, n))]
    if WINDOW <= size < LONG:
        n = max(LEAST_WINDOW, (size - 2) // 3)
        out.append((n, -(-LEAST_WORDS * n // WINDOW)))
    return out


def needed(size: int) -> float:
    """Words that a leak of an item of so many words covers at least."""
    return max(COVER * size, least_tokens(size))


class Index:
    """Windows of benchmark items, sorted by hash."""

    def __init__(self, rows: Iterable[tuple[Any, str]], lexicon: Lexicon | None = None) -> None:
        lexicon = lexicon or Lexicon()
        self.items = [item for item_id, text in rows if (item := item_of(item_id, text, lexicon)) is not None]
        hashes, items, places, kinds = [], [], [], []
        for number, item in enumerate(self.items):
            for r, n, found, keep in item_windows(item):
                hashes.append(found)
                items.append(np.full(len(keep), number))
                places.append(keep)
                kinds.append(np.full(len(keep), r * 64 + n))
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.item, self.place, self.kind = (np.concatenate(x)[order].astype(np.int32) if x else np.zeros(0, np.int32) for x in (items, places, kinds))
        self.kinds = [(int(k) // 64, int(k) % 64) for k in np.unique(self.kind)]
        self.here = np.zeros(1 << BITS, bool)
        self.here[self.hash >> np.uint64(64 - BITS)] = True
        self.longest = max((len(i.words) for i in self.items), default=0)

    def hits(self, found: list[Reading]) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, reading, width, place in the document, place in the item) of all equal windows."""
        runs = [Runs(r.token) for r in found]
        for r, n in self.kinds:
            h = salted(runs[r].of(n), r, n)
            maybe = np.flatnonzero(self.here[h >> np.uint64(64 - BITS)])
            first = np.searchsorted(self.hash, h[maybe], "left")
            last = np.searchsorted(self.hash, h[maybe], "right")
            some = last > first
            for at, a, b in zip(maybe[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
                for k in range(a, b):
                    yield int(self.item[k]), r, n, at, int(self.place[k])

    def leaks(self, words: list[str], lexicon: Lexicon) -> list[tuple]:
        """(item_id, matched tokens, cover, slot consistency, same slots, first and last word) of one document."""
        return self.leaks_of([words], lexicon)[0]

    def leaks_of(self, texts: Iterable[list[str]], lexicon: Lexicon) -> list[list[tuple]]:
        """The leaks of each document."""
        texts = list(texts)
        best: list[dict] = [{} for _ in texts]
        for words, pieces in together(texts, self.longest, lexicon):
            self.read(words, [(begin, start, best[number]) for begin, start, number in pieces], lexicon)
        return [sorted(b.values()) for b in best]

    def read(self, words: list[str], parts: list[tuple[int, int, dict]], lexicon: Lexicon) -> None:
        """Put the leaks of parts of documents (first word, its place in the document, best leak by item) to the best."""
        token, flag, at = lexicon.tokens(words)
        found = readings(token, flag)
        begins = np.array([p[0] for p in parts])
        matched: dict[tuple[int, int], dict[tuple[int, int], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, r, n, doc, place in self.hits(found):
            part = int(np.searchsorted(begins, at[found[r].start[doc]], "right")) - 1
            matched[part, item][r, doc - place].update(range(place, place + n))
        for (part, number), stretches in matched.items():
            begin, start, best = parts[part]
            for row in self.judge(self.items[number], stretches, found, words, at):
                row = (*row[:5], row[5] - begin + start, row[6] - begin + start)
                if number not in best or (row[1], -row[5]) > (best[number][1], -best[number][5]):
                    best[number] = row

    def judge(self, item: Item, stretches: dict[tuple[int, int], set[int]], found: list[Reading], words: list[str], at: np.ndarray) -> Iterator[tuple]:
        """The leaks among the matched stretches (reading, shift) of an item: each diagonal, and each with its neighbours."""
        size = len(item.words)
        diagonals = defaultdict(list)
        # Words as they are come first: a name that the document lengthens at an end of the copy doesn't count then.
        for (r, shift), places in sorted(stretches.items(), reverse=True):
            mine, theirs = item.readings[r].start, found[r].start
            first = min(places)
            diagonal = int(theirs[first + shift] - mine[first])
            for p in sorted(places):
                diagonals[diagonal].append((r, p, int(mine[p]), int(mine[p + 1]), int(theirs[p + shift]), int(theirs[p + shift + 1])))
        order, last = sorted(diagonals), 0
        for i, diagonal in enumerate(order):
            if (row := self.leak(item, diagonals[diagonal], words, at)) is not None:
                yield row
            last = max(last, i)
            while last + 1 < len(order) and order[last + 1] - diagonal <= max(2, size // 4):
                last += 1
            if last > i:
                near = order[i : last + 1]
                cells = [cell for d in sorted(near, key=lambda d: -len(diagonals[d])) for cell in diagonals[d]]
                if (row := self.leak(item, cells, words, at)) is not None:
                    yield row

    def leak(self, item: Item, cells: list[tuple[int, int, int, int, int, int]], words: list[str], at: np.ndarray) -> tuple | None:
        """What equal tokens (reading, place, words of the item from and to, of the document from and to) make up."""
        need = needed(len(item.words))
        if sum(b - a for _, _, a, b, _, _ in cells) < need:
            return None
        covered: set[int] = set()
        pairs, low, high = [], len(at), 0
        for r, p, a, b, c, d in cells:
            if all(i in covered for i in range(a, b)):
                continue
            new = covered.isdisjoint(range(a, b))
            covered.update(range(a, b))
            low, high = min(low, c), max(high, d)
            if new and item.readings[r].slot[p]:
                pair = value(item.words[a:b]), value([words[i] for i in at[c:d].tolist()])
                # A sentence's first word that stays is no slot.
                if r != 1 or pair[0] != pair[1]:
                    pairs.append(pair)
        cover = len(covered) / len(item.words)
        if len(covered) < need:
            return None
        forth, back = defaultdict(Counter), defaultdict(Counter)
        for a, b in pairs:
            forth[a][b] += 1
            back[b][a] += 1
        agree = sum(forth[a].most_common(1)[0][0] == b and back[b].most_common(1)[0][0] == a for a, b in pairs)
        consistency = agree / len(pairs) if pairs else 1.0
        if consistency < LEAST_CONSISTENT:
            return None
        return item.item_id, len(covered), cover, consistency, all(a == b for a, b in pairs), int(at[low]), int(at[high - 1])


def together(texts: Iterable[list[str]], longest: int, lexicon: Lexicon) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
    """Words to be read at once: short documents together, long ones in parts that overlap by twice the longest item.

    Yields the words and their parts: first word, its place in the document, number of the document.
    """
    words: list[str] = []
    pieces: list[tuple[int, int, int]] = []
    for number, text in enumerate(texts):
        for start in range(0, max(1, len(text)), PART):
            words.append(BEFORE if start == 0 or lexicon.read(text[start - 1])[1] & ENDS else BEFORE_INSIDE)
            pieces.append((len(words), start, number))
            words += text[start : start + PART + 2 * longest]
            if len(words) >= TOGETHER:
                yield words, pieces
                words, pieces = [], []
    if pieces:
        yield words, pieces


class Filter:
    """Bits of all window hashes of the benchmark."""

    def __init__(self, bits: np.ndarray, kinds: list[tuple[int, int]], longest: int) -> None:
        self.bits, self.kinds, self.longest = bits, kinds, longest
        self.power = (8 * len(bits)).bit_length() - 1

    def windows(self, texts: Iterable[list[str]], lexicon: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Number of the document and hash of the windows that may be the benchmark's, each once."""
        coarse = self.bits.view(np.uint32) != 0
        for words, pieces in together(texts, self.longest, lexicon):
            token, flag, at = lexicon.tokens(words)
            found = readings(token, flag)
            begins, numbers = np.array([p[0] for p in pieces]), np.array([p[2] for p in pieces])
            runs = [Runs(r.token) for r in found]
            for r, n in self.kinds:
                h = salted(runs[r].of(n), r, n)
                place = np.flatnonzero(coarse[h >> np.uint64(69 - self.power)])
                for shift in (64 - self.power, 40 - self.power):
                    bit = h[place] >> np.uint64(shift) & np.uint64((1 << self.power) - 1)
                    place = place[self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1]
                if len(place):
                    doc = numbers[np.searchsorted(begins, at[found[r].start[place]], "right") - 1]
                    both = np.unique(np.stack([doc.astype(np.uint64), h[place]]), axis=1)
                    yield both[0].astype(np.int64), both[1]


def digest_expr(text: str) -> Column:
    """16 bytes that stand for a text."""
    return F.substring(F.unhex(F.sha2(F.col(text).cast("binary"), 256)), 1, 16)


def benchmark_windows(items: DataFrame) -> DataFrame:
    """Windows of the items (item, text): item, hash, kind, words (that the windows of this hash cover together), need
    (words that a leak covers), size (words of the item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for part in parts(batches, 200):
            out: list[tuple] = []
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if (item := item_of(name, text, lexicon)) is None:
                    continue
                size = len(item.words)
                for r, n, found, keep in item_windows(item):
                    start = item.readings[r].start
                    uniq, inverse = np.unique(found, return_inverse=True)
                    covered = np.bincount(inverse, weights=start[keep + n] - start[keep], minlength=len(uniq))
                    out += [(name, h, r * 64 + n, int(w), needed(size), size) for h, w in zip(uniq.view(np.int64).tolist(), covered, strict=True)]
            kinds = (("item", "binary"), ("hash", "int64"), ("kind", "int32"), ("words", "int64"), ("need", "double"), ("size", "int64"))
            yield record(**{name: (list(x), kind) for (name, kind), x in zip(kinds, zip(*out, strict=True) if out else [()] * 6, strict=True)})

    return map_arrow(items, run, "item binary, hash long, kind int, words long, need double, size long")


def window_filter(windows: DataFrame) -> Filter:
    """The filter of a written table of windows; what reaches the driver is bounded by its size."""
    probes = [F.expr(f"shiftrightunsigned(hash, {shift}) & {(1 << FILTER_BITS) - 1}L") for shift in (64 - FILTER_BITS, 40 - FILTER_BITS)]
    bits = windows.select(F.explode(F.array(*probes)).alias("bit")).groupBy(F.expr("bit div 64").alias("at"))
    found = bits.agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("bits")).toArrow()
    words = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    kinds = sorted(r[0] for r in windows.select("kind").distinct().collect())
    return Filter(words.view(np.uint8), [(k // 64, k % 64) for k in kinds], windows.agg(F.max("size")).first()[0] or 0)


LEAK = "n_tokens int, cover double, consistency double, same_slots boolean, first_word long, last_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_tokens, cover, consistency, same_slots (false: re-parameterised), first_word, last_word: one row
    for each document and item it leaks, with the best stretch.

    Null and empty texts leak nothing; empty items are found nowhere; items that repeat give a row each; repeated
    documents give the same rows each. Empty tables give an empty result; other columns aren't read.
    """
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    items = materialize(items.select("item_id", digest_expr("text").alias("item"), "text"), "items")
    texts = items.select("item", "text").dropDuplicates(["item"])
    windows = materialize(benchmark_windows(texts), "windows")
    wanted = window_filter(windows)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    rows = rows.select("doc_id", digest_expr("_text").alias("doc"), "_text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for part in parts(batches, 1000):
            for doc, found in wanted.windows((t.split() for t in part.column(1).to_pylist()), lexicon):
                yield record(doc=part.column(0).take(pa.array(doc)), hash=pa.array(found.view(np.int64)))

    hits = map_arrow(rows.select("doc", "_text"), search, "doc binary, hash long")
    # An upper bound of what the common windows cover, over all copies of a text: only pairs beyond it can be leaks.
    pairs = hits.join(windows.select("item", "hash", "words", "need"), "hash").groupBy("doc", "item").agg(F.sum("words").alias("_most"), F.first("need").alias("need"))
    pairs = materialize(pairs.where("_most >= need").select("doc", "item"), "candidates")
    lists = pairs.join(texts, "item").groupBy("doc").agg(F.collect_list(F.struct("item", "text")).alias("items"))
    found = rows.select("doc", "_text").join(pairs.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"]).join(lists, "doc")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for part in parts(batches, 100):
            asked = {i["item"]: i["text"] for row in part.column(2).to_pylist() for i in row}
            index = Index(sorted(asked.items()), lexicon)
            leaks = index.leaks_of((t.split() for t in part.column(1).to_pylist()), lexicon)
            out = [(doc, *leak) for doc, of in zip(part.column(0).to_pylist(), leaks, strict=True) for leak in of]
            kinds = (("doc", "binary"), ("item", "binary"), ("n_tokens", "int32"), ("cover", "double"), ("consistency", "double"), ("same_slots", "bool"), ("first_word", "int64"), ("last_word", "int64"))
            yield record(**{name: (list(x), kind) for (name, kind), x in zip(kinds, zip(*out, strict=True) if out else [()] * 8, strict=True)})

    leaks = materialize(map_arrow(found.select("doc", "_text", "items"), compare, f"doc binary, item binary, {LEAK}"), "leaks")
    out = rows.select("doc_id", "doc").join(leaks, "doc").join(items.select("item_id", "item"), "item")
    return out.select("doc_id", "item_id", *leaks.columns[2:])
