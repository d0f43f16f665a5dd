"""PII: base spans equal the plain patterns on random and odd texts; labelers, added spans, redaction, edge cases."""

import random
import re

from pyspark.sql import functions as F

from assayloom.llm import pii


def luhn(s: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(m: str) -> str:
    return re.sub("[^0-9]", "", m)


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
]


def brute(text: str | None) -> list[tuple]:
    return [(k, m.start(), m.end()) for k, p, ok in PLAIN for m in re.finditer(p, text or "") if ok(m[0])]


def texts() -> list[str | None]:
    rng = random.Random(5)
    out = [None, "", "a@b.c_d@e.f.g@h.i", "a@b a@b.c. x@-.-", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1..2.3.4", "4111 1111 1111 1111", "4111-1111-1111-11110", "é😀 4111111111111111é", "+1 (716) 555-8176 ++49 30 1234567) +12", "+1 23", "x" * 60000 + "@", "1" * 50000, "1 " * 20000, "4111111111111111,4012888888881881"]
    for alphabet, n in (("ab.@_-%1 ", 40), ("12.5 0-", 60), ("41 -", 50), ("+1 ().-2x", 40)):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, n))) for _ in range(400)]
    out += ["".join(rng.choice(["4111111111111111", " ", "-", "1", "+", "4012 8888 8888 1881", "a@b.cd", "10.0.0.1", "."]) for _ in range(8)) for _ in range(300)]
    return out


def test_base_spans_equal_the_plain_patterns(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as found", "2 as kind")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find_spans(docs).collect()}
    assert len(got) == len(rows)
    wrong = [(t, brute(t), got[i]) for i, t in rows if got[i] != brute(t)]
    assert not wrong, wrong[:3]


def test_added_spans_and_redaction(spark):
    data = [(i, f"please call {200 + i}-555-01{i:02d} or mail to user{i}@mail.example.com now") for i in range(60)]
    data += [(100 + i, f"contact jane{i} [at] site [dot] com today") for i in range(40)]
    data += [(200, "version 10.1 page 3"), (201, "é +1 716 555 8176 é"), (201, "é +1 716 555 8176 é"), (202, None), (203, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("spans", F.lit(7))
    found = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    assert [s.kind for s in found[5].spans] == ["email", "local"] and [s.kind for s in found[5].base] == ["email"]
    assert [s.kind for s in found[110].spans] == ["mailto"] and not found[110].base
    assert not found[200].spans and not found[202].spans and not found[203].spans
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    by = {r.doc_id: r.text for r in clean.collect()}
    assert by[5] == "please call [LOCAL] or mail to [EMAIL] now" and by[201] == "é [PHONE] é" and by[200] == "version 10.1 page 3"
    assert by[202] is None and by[203] == "" and clean.count() == len(data)
    assert pii.find_spans(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_estimation_finds_the_useless_labeler():
    rng = random.Random(2)
    counted: dict = {}
    for _ in range(20000):
        true = rng.random() < 0.4
        votes = [1 if (rng.random() < p) == true else -1 for p in (0.95, 0.9, 0.85)]
        votes += [rng.choice((-1, 1)), 0]
        key = ("email", *votes)
        counted[key] = counted.get(key, 0) + 1
    right, prior, _ = pii.estimate([(*k, n) for k, n in counted.items()])
    a, b = right["email", "strict"]
    assert a > 0.9 and b < 0.1 and abs(prior["email"] - 0.4) < 0.05
    a, b = right["email", "context"]
    assert abs(a - b) < 0.05


def test_long_texts_take_linear_time(spark):
    n = 40_000
    text = " ".join(f"u{i}@m{i % 97}.example.com" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    base = pii.find_spans(docs).first().base
    assert len(base) == n and [(c.start, c.end) for c in base[:2000]] == [(m.start(), m.end()) for m in re.finditer(r"\S+", text)][:2000] and base[-1].end == len(text)
    assert pii.redact(docs).first().text == " ".join(["[EMAIL]"] * n)


def test_redaction_equals_brute_force(spark):
    rng = random.Random(6)
    bits = ["a.b@c.de", "1.2.3.4", "4111 1111 1111 1111", "+1 716 555 8176", "x [at] y [dot] com", " ", "é😀", "\n", "555-123-4567", "123-45-6789", "DE44 5001 0517 5407 3249 31", "z" * 700, "10.0.0.1@host.com"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for r in pii.find_spans(docs).collect():
        text, out, at = dict(rows)[r.doc_id], "", 0
        for start, end, kind in sorted((c.start, c.end, c.kind) for c in r.spans):
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert clean[r.doc_id] == out + text[at:]
        extra = [(c.kind, c.start, c.end) for c in r.spans if c.kind in pii.EXTRA]
        plain = {(k, m.start(), m.end()) for k in pii.EXTRA for m in re.finditer(pii.PATTERNS[k], text, re.ASCII)}
        assert set(extra) <= plain
