"""Near duplicates: components equal brute force on planted groups; hashing, densification, edge cases."""

import random

import numpy as np
import pytest

from assayloom.llm import neardup, shingles
from assayloom.session import materialize


def word_set(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: word_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def documents():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    shared = [rng.choice(words) for _ in range(40)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 9, 60, 200]))]
        for _ in range(rng.choice([1, 3, 25])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text) if g % 3 else " ".join(text + shared))
    rows += ["", None, " \t\n", "one two", "One  TWO", "one two three", "a b c d e", "A b\tc\nd e", "é b c d e", "É b c d e", "x " * 9000]
    rows += [rows[0], rows[5], rows[5]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_components_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", bound)
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as key", "3 as n")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    want = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_prefix_pairs_are_complete(spark):
    """Stars that link nothing leave all the work to the exact join."""
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: word_set(t) for i, t in rows}
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    ids = [i for s, i in first.items() if s]
    texts = materialize(neardup.signatures(docs), "signatures")
    row = {r.id: r.row for r in texts.collect()}
    members = spark.createDataFrame([(row[i], row[i], True) for i in ids], "row long, label long, stray boolean")
    pairs = {(r.a, r.b) for r in neardup.prefix_pairs(texts, members).collect()}
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                assert (max(row[a], row[b]), min(row[a], row[b])) in pairs


def test_repeated_and_missing_ids(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(59)]
    inside = " ".join(base[:58])  # 54 of 55 shingles
    other = [" ".join(f"{rng.randint(0, 999)}" for _ in range(30)) for _ in range(4)]
    rows = [(5, " ".join(base)), (None, inside), (None, other[0]), (None, other[0] + " x"), (7, other[1]), (7, other[2]), (3, other[2]), (9, other[1]), (7, ""), (None, None), (2, other[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as words", "3 as digest", "4 as bands")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in neardup.near_duplicates(docs).collect())
    # A row without an id is linked; rows of one id are one document, and link what each of them is linked with.
    assert got == sorted([(5, 55, 5, True), (0, 54, 5, False), (0, 26, 0, True), (0, 27, 0, True), (7, 26, 3, False), (7, 26, 3, False), (3, 26, 3, True), (9, 26, 3, False), (7, 0, 7, True), (0, 0, 0, True), (2, 26, 2, True)])
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_words_of_one_hash_are_no_link(spark, monkeypatch):
    """Links are confirmed on words: equal hashes make candidates only."""
    a, b = ("".join("ab"[bin(i + k).count("1") & 1] for i in range(1024)) for k in (0, 1024))
    assert neardup.near_duplicates(spark.createDataFrame([(1, a), (2, b.translate(str.maketrans("ab", "ba")) if a == b else b)], "doc_id long, text string")).where("kept").count() == 2 - (a == b)
    assert shingles.common_and_union(b"a b c d e f", b"a b c d e g") == (1, 3)
    rng = random.Random(1)
    for _ in range(300):
        x, y = (" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(2))
        common, union = shingles.common_and_union(x.encode(), y.encode())
        s, t = word_set(x), word_set(y)
        assert common == len(s & t) and (not s or not t or not common or union == len(s | t))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 2000):
        a = np.unique(shingles.mix(rng.integers(0, 2**63, n).astype(np.uint64)))
        b = np.unique(np.concatenate([a[: int(len(a) * 6 / 7) + 1], shingles.mix(rng.integers(0, 2**63, max(1, n // 7)).astype(np.uint64))]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((neardup.signature(a) == neardup.signature(b)).mean() - true) < 0.2
        assert len(neardup.band_keys(neardup.signature(a))) == neardup.BANDS


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 200), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in neardup.components(chain).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[200] == got[300] == 100


@pytest.mark.parametrize("bound", [1_000_000, 40, 0])
def test_components_of_random_graphs(spark, monkeypatch, bound):
    """Alike, whether the driver joins up all edges, those left after some rounds, or none."""
    monkeypatch.setattr(neardup, "MOST_EDGES", bound)
    rng = random.Random(bound)
    edges = [(rng.randrange(-90, 90) * 2**40 + 1, rng.randrange(-90, 90) * 2**40 + 1) for _ in range(75)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = neardup.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(label.items())
    assert neardup.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_few_links_take_few_jobs(spark):
    """Rounds of stars over a few links were most of the jobs, whose tasks and plans fill the driver's memory."""
    tracker, group = spark.sparkContext.statusTracker(), "few-links"
    docs = materialize(spark.createDataFrame(documents(), "doc_id long, text string"), "documents")
    spark.sparkContext.setJobGroup(group, group)
    try:
        neardup.near_duplicates(docs).write.format("noop").mode("overwrite").save()
        jobs = len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 80
