"""Strings within few edits of those of a block, by a walk over the block's trie: exact, each pair found once."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Strings that walk a trie together, and the children looked at in one step, at most; found pairs of a batch, about.
TOGETHER = 16
STEP = 1 << 18
MOST_FOUND = 1 << 15
#: Letters of a block up to which each has a place of its own in the tables of a walk.
FEW_LETTERS = 32


@cache
def automaton(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the edit distance, 2k - 1 places around its diagonal, values from k on as k: (rows, the row after each row and
    each set of places where the letters are equal). Row 0 is where a walk begins."""
    width = 2 * k - 1
    equal = (np.arange(1 << width)[:, None] >> np.arange(width)) & 1
    begin = tuple(max(0, o - k + 1) if o >= k - 1 else k for o in range(width))
    rows, number, after, at = [begin], {begin: 0}, [], 0
    while at < len(rows):
        row = rows[at]
        new = np.full((1 << width, width), k)
        for o in range(width):
            new[:, o] = np.minimum(k, row[o] + 1 - equal[:, o])
            if o + 1 < width:
                new[:, o] = np.minimum(new[:, o], row[o + 1] + 1)
            if o:
                new[:, o] = np.minimum(new[:, o], new[:, o - 1] + 1)
        found, which = np.unique(new, axis=0, return_inverse=True)
        ids = []
        for r in map(tuple, found.tolist()):
            if r not in number:
                number[r] = len(rows)
                rows.append(r)
            ids.append(number[r])
        after.append(np.array(ids, np.int32)[which.ravel()])
        at += 1
    return np.array(rows, np.int32), np.stack(after)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts on end, and the texts' lengths."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def letter_table(codes: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` places for each text; places behind its end are 0."""
    table = np.zeros((len(n), width), codes.dtype)
    table[np.arange(width) < n[:, None]] = codes
    return table


def trie(names: pa.Array) -> dict:
    """The trie of distinct strings: their array in order; by level each node's first child (and one more), letter, string
    that ends there (or -1) and the number of strings up to its last."""
    texts = names.to_pylist()
    flat, n = code_points(texts)
    letters, codes = np.unique(flat, return_inverse=True)
    kind = np.uint8 if len(letters) < 255 else np.uint32
    table = letter_table(codes.astype(kind) + kind(1), n, int(n.max(initial=0)))
    order = np.lexsort((n, *table.T[::-1]))  # equal but for letters that 0 stands for: none, as codes begin at 1
    table, n = table[order], n[order]
    x = {"names": names.take(pa.array(order)), "letters": letters, "child": [], "letter": [None], "ends": [], "upto": []}
    node = np.zeros(len(n), np.int64)
    first = np.zeros(min(1, len(n)), np.int64)  # the nodes' first strings
    changed = np.arange(len(n)) == 0
    for level in range(table.shape[1] + 1):
        x["ends"].append(np.where(n[first] == level, first, -1).astype(np.int32))
        alive = np.flatnonzero(n >= level)
        x["upto"].append(alive[np.searchsorted(node[alive], np.arange(len(first)), "right") - 1].astype(np.int32) + 1 if len(first) else first.astype(np.int32))
        if level == table.shape[1]:
            break
        changed[1:] |= table[1:, level] != table[:-1, level]
        new = np.flatnonzero(changed & (n > level))
        x["child"].append(np.searchsorted(node[new], np.arange(len(first) + 1)).astype(np.int32))
        x["letter"].append(table[new, level].astype(np.int32) - 1)
        node = np.cumsum(changed & (n > level)) - 1
        first = new
    return x


def near_in_trie(x: dict, texts: list[str], k: int, later: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, place of the trie's string, distance) of pairs nearer than k edits; ``later``: only of strings
    that come after the text. Texts go down the trie together, each with the nodes that may still lead to a near string."""
    rows, after = automaton(k)
    width, depth, size = 2 * k - 1, len(x["child"]), len(x["letters"])
    # Values up to each number of places of a row, least and last.
    edge = np.full((len(rows), 1), k, np.int32)
    least, last = np.minimum.accumulate(np.concatenate([edge, rows], 1), 1), np.concatenate([edge, rows, edge], 1)
    found, many = [], 0
    for begin in range(0, len(texts) if len(x["names"]) else 0, TOGETHER):
        part = texts[begin : begin + TOGETHER]
        flat, n = code_points(part)
        codes = np.searchsorted(x["letters"], flat)
        codes = np.where(np.append(x["letters"], 0)[codes] == flat, codes, size) if size else np.zeros(len(flat), np.int64)
        own = np.arange(size) if size <= FEW_LETTERS else np.unique(codes[codes < size])  # letters other than these equal none
        number = np.full(size + 1, len(own), np.int32)
        number[own] = np.arange(len(own))
        line = np.zeros((len(part), k - 1 + max(depth, int(n.max())) + k), np.int64)
        line[:, k - 1 : k - 1 + int(n.max())] = letter_table(number[codes] + 1, n, int(n.max()))
        equal = np.zeros((len(part), depth, len(own) + 1), np.int32)  # where around the diagonal a text has a letter
        for o in range(width):
            i, level = np.nonzero(line[:, o : o + depth])
            equal[i, level, line[i, level + o] - 1] |= 1 << o
        equal[:, :, len(own)] = 0
        skip = np.zeros(len(part), np.int64)
        if later:
            skip[:] = [bisect.bisect_right(range(len(x["names"])), t, key=lambda i: x["names"][i].as_py()) for t in part]
        if x["ends"][0][0] >= 0:  # the empty string
            i = np.flatnonzero((n < k) & (skip == 0))
            found.append((i + begin, np.zeros(len(i), np.int64), n[i]))
        steps: list = [None] * depth
        start = np.arange(len(part), dtype=np.int32)  # (row of the distance, text) as one number
        stack = [(0, start * 0, start)] if depth else []
        while stack:
            level, node, at = stack.pop()
            if steps[level] is None:  # the first child to be visited; what follows a row and a letter, or -1; distances at the end
                ahead = np.clip(n - level - 1 + k, 0, width + 1)
                follow = after[np.arange(len(rows))[:, None, None], equal[None, :, level]] * len(part) + start[None, :, None]
                shut = least[:, np.minimum(ahead, width)] >= k
                follow = np.where(shut.ravel()[follow], np.int32(-1), follow)
                steps[level] = np.searchsorted(x["upto"][level + 1], skip, "right").astype(np.int32), follow.astype(np.int32).ravel(), last[:, ahead].ravel()
            begins, follow, distance = steps[level]
            low = np.maximum(x["child"][level][node], begins[at % len(part)]) if later else x["child"][level][node]
            count = np.maximum(x["child"][level][node + 1] - low, 0)
            upto = np.cumsum(count, dtype=np.int32 if len(node) < STEP else np.int64)
            total = int(upto[-1])
            if len(node) > 1 and (total > STEP or len(node) >= STEP):
                half = len(node) // 2
                stack += [(level, node[half:], at[half:]), (level, node[:half], at[:half])]
                continue
            child = np.arange(total, dtype=np.int32) + np.repeat((low - (upto - count)).astype(np.int32), count)
            letter = x["letter"][level + 1][child]
            if size > FEW_LETTERS:
                letter = number[letter]
            at = follow[np.repeat(at * (len(own) + 1), count) + letter]
            keep = np.flatnonzero(at >= 0)
            child, at = child[keep], at[keep]
            ends = x["ends"][level + 1][child]
            hit = np.flatnonzero((distance[at] < k) & (ends >= 0))
            if len(hit):
                i, end = at[hit] % len(part), ends[hit]
                if later:
                    ok = end >= skip[i]
                    hit, i, end = hit[ok], i[ok], end[ok]
                found.append((i + begin, end, distance[at[hit]]))
                many += len(hit)
            if level + 1 < depth and len(child):
                stack.append((level + 1, child, at))
            if many >= MOST_FOUND:
                yield from in_batches(found)
                found, many = [], 0
    yield from in_batches(found)


def in_batches(found: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if found:
        a, b, distance = (np.concatenate(c) for c in zip(*found, strict=True))
        for low, high in pairwise([*range(0, len(a), 2 * MOST_FOUND), len(a)]):
            yield a[low:high], b[low:high], distance[low:high]
