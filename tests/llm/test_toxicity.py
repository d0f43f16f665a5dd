"""Toxicity: held-out accuracy on a planted lexicon, block-wise scoring, and edge cases."""

import math
import random

import numpy as np

from assayloom.llm import toxicity

GOOD = ["river", "stone", "garden", "window", "market", "silver", "letter", "summer"]
BAD = ["grubface", "sludgehead"]


def sample(seed: int, n: int):
    rng = random.Random(seed)
    for i in range(n):
        words = [rng.choice(GOOD) + rng.choice(["s", "", "y"]) for _ in range(rng.randint(5, 300))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "s", "ed"])
        yield " ".join(words), int(i % 3 == 0)


def test_held_out_accuracy():
    texts, marks = zip(*sample(1, 600), strict=True)
    scorer = toxicity.Scorer(toxicity.fit(list(texts), list(marks)))
    right = [(scorer.score(t) >= toxicity.THRESHOLD) == bool(y) for t, y in sample(2, 300)]
    assert sum(right) >= 297
    assert scorer.score(None) == scorer.score("") < 0.5


def test_blocks_give_the_same_score(monkeypatch):
    texts, marks = zip(*sample(1, 300), strict=True)
    scorer = toxicity.Scorer(toxicity.fit(list(texts), list(marks)))
    long = " ".join(t for t, y in sample(5, 90) if not y) + " grubface " + " ".join(GOOD * 50)
    whole = scorer.score(long)
    monkeypatch.setattr(toxicity, "BLOCK", 997)
    assert abs(scorer.score(long) - whole) < 1e-9 and whole > 0.7


def test_table(spark):
    rows = [(i, t) for i, (t, _) in enumerate(sample(3, 300))] + [(900, None), (901, ""), (None, "river grubface")]
    marks = [(i, y, "x") for i, (_, y) in enumerate(sample(3, 300))] + [(900, 1, "x"), (None, 1, "x"), (5000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as toxic", "3 as _id", "4 as _toxic")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text string")
    found = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r.score for r in found}
    assert sum((by[i] >= 0.7) == bool(y) for i, (_, y) in enumerate(sample(3, 300))) >= 295
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


def test_model_equals_brute_force():
    """Ratios and scores by plain dictionaries of strings."""
    texts, marks = zip(*sample(4, 120), strict=True)
    texts = [*texts, "Straße ПЛОХО река", "плохо 漢字かな 😀 x"]
    marks = [*marks, 1, 0]
    model = toxicity.fit(texts, marks)

    def grams(text):
        s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        return {s[i : i + n] for n in toxicity.LENGTHS for i in range(len(s) - n + 1)}

    counts: dict = {}
    for t, y in zip(texts, marks, strict=True):
        for g in grams(t):
            counts.setdefault(g, [0, 0])[y] += 1
    sizes = (len(marks) - sum(marks), sum(marks))
    ratio = {g: math.log((c[1] + 1) / (sizes[1] + 2)) - math.log((c[0] + 1) / (sizes[0] + 2)) for g, c in counts.items()}
    telling = {g for g, r in ratio.items() if abs(r) >= toxicity.LEAST_RATIO and sum(counts[g]) >= toxicity.LEAST_DOCS}
    assert len(telling) == len(model.code)

    def code(g):
        marks_ = np.array([ord(c) if c.isalpha() else 1 for c in g], np.uint64)
        return int(list(toxicity.codes(marks_))[len(g) - 3][0])

    weight = dict(zip(model.code.tolist(), model.weight.tolist(), strict=True))
    scorer = toxicity.Scorer(model)
    for t, _ in sample(6, 40):
        z = model.bias + sum(weight[code(g)] for g in grams(t) & telling)
        assert abs(scorer.score(t) - 1 / (1 + math.exp(-z))) < 1e-9
