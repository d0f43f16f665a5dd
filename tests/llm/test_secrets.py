"""Secrets: base spans equal the plain patterns, the network's held-out recall and precision, edge cases."""

import random
import re

import numpy as np

from assayloom.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    bits = ["password", "PassWD", "secret", "toKen", "apikey", "api_key", '"', "'", " ", ":", "=", "abcdefgh", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "f", "é", "x=", "\n", "token=token=abcdefghi"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert secrets.base_spans(text) == brute(text), text


def test_network_on_new_findings():
    model = secrets.fit(secrets.labelled_findings())
    new = secrets.labelled_findings(2000, seed=99)
    p = secrets.probability(model, [secrets.view(t, s, e) for t, s, e, _ in new])
    y = np.array([f[3] for f in new])
    assert (p[y == 1] >= model.threshold).mean() >= 0.96
    assert (p[y == 0] >= model.threshold).mean() <= 0.05
    assert abs(p.mean() - y.mean()) < 0.05  # calibrated


def test_whole_candidates_are_read():
    model = secrets.fit(secrets.labelled_findings(1000), epochs=2)
    path = "/".join(["some", "long", "path"] * 30)
    key = "x7Kq9ZpL2mN4vR8sT1wYb3Hd6J"
    plain, mixed = path, path[:200] + key + path[200:]
    a, b = secrets.probability(model, [secrets.view(t, 0, len(t)) for t in (plain, mixed)])
    assert a != b
    # Windows and batches give what one window over the whole gives.
    views = [secrets.view(t, 0, len(t)) for t in (plain, mixed, "ab", "k" * 5000)]
    z = []
    for v in views:
        e = model.embed[np.frombuffer(v, np.uint8)]
        hidden = np.concatenate([e[i : len(e) - secrets.WIDTH + 1 + i] for i in range(secrets.WIDTH)], axis=1) @ model.filters + model.offset
        z.append(np.maximum(hidden.max(axis=0), 0) @ model.out + model.bias)
    assert np.allclose(secrets.logits(model, views), z, atol=1e-4)


def test_generic_candidates_equal_brute_force():
    rng = random.Random(8)
    bits = ["password=abcdefgh", "0123456789abcdef" * 2, "AKIA" + "A1" * 8, "key9Key9Key9Key9", "--------------------", "Wortungeheuerlichkeit", " ", "/", "=", "é"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        base = secrets.base_spans(text)
        want = [(m.start(), m.end(), "generic") for m in secrets.GENERIC.finditer(text) if any(c.isalnum() for c in m[0]) and not any(s < m.end() and m.start() < e for s, e, _ in base)]
        assert secrets.generic_spans(text, base) == want
    many = " ".join(f"token=abcdefgh{i} AAbb00cc11dd22ee33ff{i}" for i in range(100_000))
    assert len(secrets.scan_text(many)) == 200_000


def test_table(spark):
    model = secrets.fit(secrets.labelled_findings())
    key = "zQ9xT4mB7vK2pL8wR5nJ1cH6dF3gS0aY"
    rows = [(1, "é token = 'abcdefgh1' end"), (2, f"auth {key} there"), (2, f"auth {key} there"), (3, None), (4, ""), (5, "plain words only " * 5000), (None, "AKIA" + "A1" * 8), (6, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as found", "2 as _text2")
    found = {r.doc_id: r.found for r in secrets.find_secrets(docs, model).collect()}
    assert len(found) == 7 and [(s.kind, s.start, s.end) for s in found[1]] == [("assign", 2, 20)]
    assert [(s.kind, s.start, s.end) for s in found[2]] == [("generic", 5, 5 + len(key))]
    assert not found[3] and not found[4] and not found[5] and not found[6] and found[None][0].kind == "access"
    assert secrets.find_secrets(docs.limit(0), model).count() == 0
