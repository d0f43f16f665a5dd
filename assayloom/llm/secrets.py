"""Secret scan: a character convolutional network in numpy scores every candidate with its surrounding context.

Candidates are the base patterns (assign, access, hex) and any other long run of key-like characters (``generic``). The
network reads up to 24 characters before, the whole candidate and up to 8 after: an embedding, one convolution of width 5,
rectified, pooled by maximum over all places, and a logistic output. Long candidates are read in windows of ``SPAN``
places, whose maxima are pooled in turn, so no character goes unread and memory is bounded.

It is trained on labelled findings: (text, start, end, 1 or 0), by default those of ``labelled_findings``, written by rule
from a seed, in equal parts: keys, hashes and tokens of many forms against identifiers, paths, UUIDs, dates and numbers.
Three parts are held apart: on 70 % the network is trained, on 15 % the scores are calibrated (Platt), and on the last
15 % the threshold is the highest that still finds ``RECALL`` of the true ones. Base matches are always spans; a generic
candidate is one from the threshold on.
"""

from __future__ import annotations

import bisect
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.worker import map_arrow, parts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "generic")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: What a text must contain for an assignment to be searched in it (lower case).
HINTS = ("passw", "secret", "token", "apikey", "api_key")
LEFT, RIGHT = 24, 8
WIDTH, EMBED, FILTERS = 5, 12, 32
#: Places that a window of the network covers.
SPAN = 92
RECALL = 0.98
#: Character numbers: 1 to 95 for printable ASCII, 96 for others, 97 for the marks.
NUMBERS = bytes(97 if c == 1 else c - 31 if 32 <= c <= 126 else 96 for c in range(256))
FINDINGS = 6000
#: Windows scored at a time.
BATCH = 1024


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def generic_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Other key-like runs with a letter or digit that overlap no base match."""
    starts, reach, out = [s for s, _, _ in base], [], []
    for _, e, _ in base:  # how far the base matches up to each one reach
        reach.append(max(e, reach[-1]) if reach else e)
    for m in GENERIC.finditer(text):
        before = bisect.bisect_left(starts, m.end())  # base matches that start before its end
        if not (before and reach[before - 1] > m.start()) and any(map(str.isalnum, m[0])):
            out.append((m.start(), m.end(), "generic"))
    return out


def view(text: str, start: int, end: int) -> bytes:
    """What the network reads: character numbers, with marks at the borders of the candidate, and an empty end."""
    parts = (text[max(0, start - LEFT) : start], text[start:end], text[end : end + RIGHT])
    left, inside, right = (part.encode("ascii", "replace") if part.isascii() else bytes(ord(c) if c.isascii() else 127 for c in part) for part in parts)
    return (left + b"\x01" + inside + b"\x01" + right).translate(NUMBERS) + bytes(WIDTH)


def windows(views: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all views, overlapping so that every place of the convolution is in one; first window of each view."""
    size, step = SPAN + WIDTH - 1, SPAN
    counts = [max(1, -(-(len(v) - WIDTH + 1) // step)) for v in views]
    flat = b"".join(v[i * step : i * step + size].ljust(size, b"\0") for v, n in zip(views, counts, strict=True) for i in range(n))
    return np.frombuffer(flat, np.uint8).reshape(-1, size), np.cumsum([0, *counts])[:-1]


@dataclass
class Model:
    embed: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5


def pooled(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximum of each filter over a window's places, where it is, and what the filters read."""
    e = model.embed[x]
    places = x.shape[1] - WIDTH + 1
    cols = np.concatenate([e[:, i : i + places] for i in range(WIDTH)], axis=2)
    hidden = cols @ model.filters + model.offset
    best = hidden.argmax(axis=1)
    return np.take_along_axis(hidden, best[:, None, :], axis=1)[:, 0, :], best, cols


def logits(model: Model, views: list[bytes]) -> np.ndarray:
    """One for each view, pooled over its windows; so many windows at a time."""
    out, at = [], 0
    while at < len(views):
        end, size = at, 0
        while end < len(views) and (end == at or size + len(views[end]) <= BATCH * SPAN):
            size += len(views[end])
            end += 1
        x, first = windows(views[at:end])
        top = np.concatenate([pooled(model, x[i : i + BATCH])[0] for i in range(0, len(x), BATCH)])
        out.append(np.maximum(np.maximum.reduceat(top, first, axis=0), 0) @ model.out + model.bias)
        at = end
    return np.concatenate(out) if out else np.zeros(0)


def probability(model: Model, views: list[bytes]) -> np.ndarray:
    """Calibrated scores."""
    return 1 / (1 + np.exp(-np.clip(model.scale * logits(model, views) + model.shift, -40, 40)))


def fit(findings: list[tuple[str, int, int, int]], epochs: int = 10, seed: int = 11) -> Model:
    """Train on seven tenths of the findings; calibrate on one half of the rest, set the threshold on the other."""
    rng = np.random.default_rng(seed)
    views = [view(t, s, e) for t, s, e, _ in findings]
    y = np.array([f[3] for f in findings], np.float32)
    order = rng.permutation(len(views))
    scaled, judged, rest = np.split(order, [len(order) * 15 // 100, len(order) * 30 // 100])
    f32 = np.float32
    model = Model(rng.normal(0, 0.3, (98, EMBED)).astype(f32), rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)).astype(f32), np.zeros(FILTERS, f32), rng.normal(0, 0.2, FILTERS).astype(f32), 0.0)
    names = ("embed", "filters", "offset", "out")
    first = {n: np.zeros_like(getattr(model, n)) for n in names}
    second = {n: np.zeros_like(getattr(model, n)) for n in names}
    k = 0
    for _ in range(epochs):
        rest = rng.permutation(rest)
        for at in range(0, len(rest), 128):
            part = rest[at : at + 128]
            x, begins = windows([views[i] for i in part])
            top, best, cols = pooled(model, x)
            most = np.maximum.reduceat(top, begins, axis=0)
            # The window that each candidate's maximum of a filter comes from.
            rows = np.array([b + top[b:e].argmax(axis=0) for b, e in zip(begins, [*begins[1:], len(x)], strict=True)])
            where = np.take_along_axis(best, rows, axis=0)
            active = np.maximum(most, 0)
            z = active @ model.out + model.bias
            g = ((1 / (1 + np.exp(-z)) - y[part]) / len(part)).astype(f32)
            back = np.where(most > 0, g[:, None] * model.out, 0).astype(f32)
            picked = cols[rows, where]  # example x filter x (width * embedding)
            grad = {"out": active.T @ g, "offset": back.sum(axis=0), "filters": np.einsum("nf,nfd->df", back, picked)}
            into = np.zeros_like(model.embed)
            d = (back[:, :, None] * model.filters.T[None]).reshape(len(part), FILTERS, WIDTH, EMBED)
            for i in range(WIDTH):
                np.add.at(into, x[rows, where + i], d[:, :, i])
            grad["embed"] = into
            k += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grad[n]
                second[n] = 0.999 * second[n] + 0.001 * grad[n] ** 2
                setattr(model, n, (getattr(model, n) - 0.004 * (first[n] / (1 - 0.9**k)) / (np.sqrt(second[n] / (1 - 0.999**k)) + 1e-8)).astype(f32))
            model.bias -= 0.1 * float(g.sum())
    z, a, b = logits(model, [views[i] for i in scaled]), 1.0, 0.0
    for _ in range(300):  # Platt scaling
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        a -= 0.1 * float(((p - y[scaled]) * z).mean()) / max(1.0, float(z.std()))
        b -= 0.1 * float((p - y[scaled]).mean())
    model.scale, model.shift = a, b
    true = np.sort(probability(model, [views[i] for i in judged if y[i] == 1]))
    model.threshold = float(true[int((1 - RECALL) * len(true))]) if len(true) else 1.0
    return model


def labelled_findings(n: int = FINDINGS, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """Labelled findings by rule: half of them secrets."""
    rng = random.Random(seed)
    pick = lambda alphabet, a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))
    alnum, lower = string.ascii_letters + string.digits, string.ascii_lowercase
    onsets = ["", "b", "br", "ch", "d", "f", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "pf", "qu", "r", "s", "sch", "st", "t", "th", "v", "w", "z"]
    vowels, codas = ["a", "e", "i", "o", "u", "ai", "au", "ea", "ei", "eu", "ie", "io", "oo", "ou"], ["", "", "", "l", "n", "r", "s", "t", "x", "ch", "ng", "nt", "rt", "ss", "ung", "keit", "lich", "ment", "tion", "dad"]
    syllable = lambda: rng.choice(onsets) + rng.choice(vowels) + rng.choice(codas)
    word = lambda k=3: "".join(syllable() for _ in range(rng.randint(1, k)))
    cased = lambda w: w.capitalize() if rng.random() < 0.3 else w
    digits = lambda k: pick(string.digits, k, k)
    true = [
        lambda: pick("0123456789abcdef", 32, 64), lambda: pick("0123456789ABCDEF", 32, 64), lambda: pick(alnum, 20, 48), lambda: pick(alnum + "+/", 24, 64) + rng.choice(["", "=", "=="]),
        lambda: rng.choice(["sk_live_", "sk_test_", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "AIza", "SG_", "npm_", "pk_"]) + pick(alnum + "_-", 20, 40), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 12, 20), lambda: "eyJ" + pick(alnum + "_-", 30, 80), lambda: pick(alnum, 16, 22), lambda: pick(alnum + "+/", 80, 160), lambda: "/".join(word() for _ in range(8)) + "/" + pick(alnum, 32, 48) + "/" + "/".join(word() for _ in range(4)),
        lambda: rng.choice(["password", "token", "secret", "api_key"]) + rng.choice(['="', ": ", "=", " = "]) + pick(alnum, 8, 24),
    ]
    false = [
        lambda: "_".join(word() for _ in range(5)) + digits(rng.randint(1, 4)), lambda: "-".join(word() for _ in range(5)) + "-" + digits(4), lambda: "/" + "/".join(word() for _ in range(5)) + "/" + word() + digits(2),
        lambda: "-".join([pick("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)]), lambda: word(8) + word(8) + word(4) + digits(rng.randint(1, 3)), lambda: digits(4) + "-" + digits(2) + "-" + digits(2) + "T" + digits(6) + "-" + word() + "-" + word(),
        lambda: word(2) + rng.choice("0123456789") * rng.randint(18, 30), lambda: (word(1) + digits(1)) * rng.randint(7, 12), lambda: "".join(word(1).capitalize() for _ in range(8)) + digits(1), lambda: rng.choice(["token", "secret", "password"]) + "_" + "_".join(word() for _ in range(5)) + digits(1),
        lambda: "-" * rng.randint(18, 30) + word() + digits(1), lambda: pick(lower[:3] + "0", 20, 30), lambda: cased("".join(syllable() for _ in range(rng.randint(4, 9)))), lambda: cased("".join(syllable() for _ in range(rng.randint(4, 9)))), lambda: digits(rng.randint(16, 24)), lambda: "/".join(word() for _ in range(rng.randint(8, 25))), lambda: "-".join(word() for _ in range(6)), lambda: rng.choice("=-_/+") * rng.randint(16, 60) + word(),
    ]
    hints = ["key: ", "token = ", '"', "Bearer ", "secret ", "id: ", "hash ", "see ", "= ", "(", ""]
    out = []
    for i in range(n):
        label = i % 2
        found = rng.choice(true if label else false)()
        before = " ".join(word() for _ in range(rng.randint(0, 6))) + " " + rng.choice(hints)
        after = rng.choice(["", '"', "###", "$$$", ".", ")", ",", " "]) + " " + " ".join(word() for _ in range(rng.randint(0, 4)))
        out.append((before + found + after, len(before), len(before) + len(found), label))
    return out


def scan_text(text: str) -> list[tuple[int, int, str]]:
    """All candidates of a text."""
    base = base_spans(text)
    return base + generic_spans(text, base)


def find_secrets(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``found``: array of (kind, start, end, score) by start, then kind as listed; code points, end exclusive.

    Every candidate is scored whole; base matches stay whatever their score. Null and empty texts have none; repeated
    rows get the same; an empty table gives an empty result; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1000):
            texts = part.column(1).to_pylist()
            spans = [scan_text(t) for t in texts]
            score = probability(model, [view(t, s, e) for t, found in zip(texts, spans, strict=True) for s, e, _ in found]).tolist()
            out, k = [], 0
            for found in spans:
                kept = [(kind, s, e, p) for (s, e, kind), p in zip(found, score[k : k + len(found)], strict=True) if kind in BASE or p >= model.threshold]
                k += len(found)
                out.append([{"kind": c[0], "start": c[1], "end": c[2], "score": c[3]} for c in sorted(kept, key=lambda c: (c[1], KINDS.index(c[0]), c[2]))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, span)], ["doc_id", "found"])

    return map_arrow(rows, run, "doc_id long, found array<struct<kind: string, start: int, end: int, score: double>>")
