"""Word shingles of whole texts as 64-bit hashes, in arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longer pieces are hashed one by one.
LONG = 64
MASK = np.array([(1 << 8 * r) - 1 for r in range(9)], np.uint64)


def lanes_of(data: bytes) -> np.ndarray:
    """At every byte the eight bytes from there as one number; ``data`` ends with eight spare bytes."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def first_lanes(lanes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return lanes[starts] & MASK[np.minimum(lengths, 8)]


def piece_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, lanes: np.ndarray | None = None, first: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of pieces of bytes, never 0: eight bytes at a time, each step a bijective mix of the state; pieces
    of up to eight bytes of equal length never collide. ``data`` ends with eight spare bytes."""
    lanes = lanes_of(data) if lanes is None else lanes
    lengths = ends - starts
    first = first_lanes(lanes, starts, lengths) if first is None else first
    out = mix(first ^ (lengths.astype(np.uint64) * _ODD[0] + _ODD[3]))
    more, at = np.flatnonzero(lengths > 8), 8
    while len(more) and at < LONG:
        out[more] = mix(out[more] * _ODD[1] + _ODD[2] ^ (lanes[starts[more] + at] & MASK[np.minimum(lengths[more] - at, 8)]))
        at += 8
        more = more[lengths[more] > at]
    for i in more.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    out[out == 0] = 1
    return out


def spans_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: cut at the space and 0x09 to 0x0D."""
    view = np.frombuffer(data, np.uint8)
    word = (view != 32) & ((view < 9) | (view > 13))
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def plain_words(data: bytes) -> bytes:
    """The words of UTF-8 text with A-Z lower-cased, one space between them."""
    return b" ".join(data.lower().split())


def words_of(data: bytes) -> np.ndarray:
    """Hashes of the words of UTF-8 text: A-Z lower-cased, cut at the space and 0x09 to 0x0D."""
    data = data.lower()
    starts, ends = spans_of(data)
    return piece_hashes(data + bytes(8), starts, ends) if len(starts) else np.zeros(0, np.uint64)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; of the whole if there are fewer; none if there is none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out + words[i : len(words) - n + 1 + i] * _ODD[i % len(_ODD)])
    return out


def shingle_set(data: bytes, n: int = 5) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(windows(words_of(data), n))


def exact_set(numbers: np.ndarray, n: int = 5) -> tuple[np.ndarray, int]:
    """Runs of n numbers (below 2**31, equal only for equal words) as numbers of their own, without hashing: equal runs and
    only those are equal. Returns the number of each run, and how many runs differ."""
    size = len(numbers) - n + 1
    rank = numbers[:size].astype(np.int64)
    for i in range(1, n):
        _, rank = np.unique(rank << 31 | numbers[i : i + size], return_inverse=True)
    return rank, int(rank.max()) + 1 if size else 0


def common_and_union(a: bytes, b: bytes, n: int = 5) -> tuple[int, int]:
    """Sizes of the intersection and union of two texts' shingle sets, compared as words; texts as by ``plain_words``."""
    x, y = a.split(), b.split()
    if not x or not y:
        return 0, 1
    if min(len(x), len(y)) < n:  # a short text's whole sequence is its one shingle
        return (1, 1) if x == y else (0, 2)
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in (*x, *y)), np.int64, len(x) + len(y))
    # Runs over the seam of both texts are left out.
    rank, total = exact_set(numbers, n)
    seen = np.zeros((2, total), bool)
    seen[0, rank[: len(x) - n + 1]] = True
    seen[1, rank[len(x) :]] = True
    return int((seen[0] & seen[1]).sum()), int((seen[0] | seen[1]).sum())
