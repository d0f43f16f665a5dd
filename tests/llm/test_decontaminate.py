"""Decontamination: copies, re-parameterised questions, inconsistent slots, clean texts, blocks and edge cases."""

import random

from assayloom.llm import decontaminate

ITEM = "Yesterday morning Alice bought 12 kg of red apples from Bob and then gave 5 kg of apples to her friend Carol before lunch"
OTHER = "Yesterday morning Dora bought 31 lb of red apples from Emil and then gave 7 lb of apples to her friend Frida before lunch"
MIXED = ITEM.replace("gave 5 kg", "gave 12 kg")


def leaks(text: str, items: list[tuple[int, str]]):
    return decontaminate.Index(items).leaks(text.split(), decontaminate.Lexicon())


def test_templates_and_slots():
    around = "some other words stand here before it, "
    same = leaks(around + ITEM + " and after.", [(7, ITEM)])
    assert [(r[0], r[4]) for r in same] == [(7, True)] and same[0][2] > 0.9
    other = leaks(around + OTHER + " and after.", [(7, ITEM)])
    assert [(r[0], r[4]) for r in other] == [(7, False)] and other[0][3] == 1.0
    assert leaks(around + ITEM.lower().replace("alice", "Alice"), [(7, ITEM)]) != []
    shuffled = "Yesterday morning Bob bought 5 kg of red apples from Bob and then gave 5 kg of apples to her friend Bob before lunch"
    assert leaks(around + shuffled, [(7, ITEM)]) == []
    assert leaks("quite different words which share nothing with the question at all in any place of it", [(7, ITEM)]) == []
    assert leaks("1 2 3 4 5 6 7 8 9 10 11 12 13", [(1, "5 6 7 8 9 1 2 3 4 5")]) == []


def test_short_items_and_parts(monkeypatch):
    assert [r[0] for r in leaks("he said blue green stone here", [(1, "Blue green stone"), (2, ""), (3, "...")])] == [1]
    monkeypatch.setattr(decontaminate, "PART", 13)
    text = " ".join(f"w{i % 7}x" for i in range(200)) + " " + ITEM + " " + " ".join(f"v{i % 5}" for i in range(100))
    assert [r[0] for r in leaks(text, [(7, ITEM)])] == [7]


def test_tables(spark, monkeypatch):
    rows = [(1, ITEM), (1, ITEM), (2, OTHER), (3, None), (4, ""), (None, "x " + ITEM), (5, "clean words only"), (6, "word " * 60000 + ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as cover")
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "another question about seven green birds over the wide quiet river")], "item_id long, text string").selectExpr("*", "3 as doc_id")
    for bits in (25, 21):
        monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
        found = decontaminate.find_leaks(docs, bench).collect()
        assert sorted((r.doc_id or 0, r.item_id, r.same_slots) for r in found) == [(0, 7, True), (1, 7, True), (1, 7, True), (2, 7, False), (6, 7, True)]
    twice = bench.unionByName(bench.selectExpr("item_id + 100 as item_id", "text", "doc_id"))
    assert decontaminate.find_leaks(docs, twice).count() == 10
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_opening_names_and_runs():
    tom = "Tom buys 5 red apples. Mia buys 7 green apples. Tom eats 2 of them. Mia gives 3 away. How many are left?"
    ben = tom.replace("Tom", "Ben").replace("Mia", "Ana").replace("5", "9")
    assert [(r[0], r[2], r[3], r[4]) for r in leaks("Here it is. " + ben + " So it ends.", [(7, tom)])] == [(7, 1.0, 1.0, False)]
    longer = ITEM.replace("Bob", "Bob Lee").replace("12", "twenty five")
    assert [(r[0], r[2]) for r in leaks("Before it. " + longer, [(7, ITEM)])] == [(7, 1.0)]


def test_exact_copies_of_slots():
    for item in ("What is 12 + 35 + 18 + 27 ?", "12 35 18 27 41 9 77 3 15", "Alice Bob 12 Carol Dora 13", "So 12 kg 13 kg 14 kg 15 kg then 16 kg"):
        assert [(r[0], r[2], r[4]) for r in leaks("they asked it once: " + item + " nobody knew", [(7, item)])] == [(7, 1.0, True)], item
    assert leaks("they asked it once: What is 12 + 35 + 19 + 27 ? nobody knew", [(7, "What is 12 + 35 + 18 + 27 ?")]) == []
    ends = "Carol has seven red apples now and three are for Carol"
    assert [(r[0], r[2], r[3]) for r in leaks("They say that " + ends + " Smith and others", [(7, ends)])] == [(7, 1.0, 1.0)]


def test_stretches_on_neighbouring_diagonals():
    w = ITEM.split()
    two = [*w[:8], "very", *w[8:16], "really", *w[16:]]
    assert [(r[0], r[2], r[4]) for r in leaks("It says: " + " ".join(two), [(7, ITEM)])] == [(7, 1.0, True)]
    less = [*w[:7], *w[8:15], *w[16:]]
    assert [r[0] for r in leaks("It says: " + " ".join(less), [(7, ITEM)])] == [7]
    assert [(r[0], r[2], r[4]) for r in leaks("it says " + ITEM.lower(), [(7, ITEM)])] == [(7, 1.0, True)]
    item = "the old miller walked slowly over seven wooden bridges until evening came down to him"
    assert [(r[0], r[1]) for r in leaks("once " + item.replace("wooden", "narrow"), [(7, item)])] == [(7, 14)]
    # Pieces far apart, out of place, or too few words of a short item are no leak.
    far = " ".join(f"f{i}" for i in range(40))
    assert leaks(f"{' '.join(w[:8])} {far} {' '.join(w[8:16])} {far} {' '.join(w[16:])}", [(7, ITEM)]) == []
    assert leaks("how many of the other things", [(7, "how many of the birds are left")]) == []
    assert leaks("how many of the other things", [(7, "how many of the birds are there now")]) == []


def words(rng, n):
    return [rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("bdglmnrst") + rng.choice(["", "a", "en", "ing"]) for _ in range(n)]


def edited(rng, item):
    """A planted copy: other numbers, other names, a word put in, dropped or changed, lower case."""
    w = item.split()
    kind = rng.choice(["same", "numbers", "names", "in", "out", "word", "lower"])
    if kind == "numbers":
        w = [str(int(x) + 7) if x.isdigit() else x for x in w]
    if kind == "names":
        other = {x: x[::-1].capitalize() for x in w[1:] if x[:1].isupper()}
        w = [other.get(x, x) for x in w]
    i = rng.randrange(len(w))
    w = [*w[:i], "quite", *w[i:]] if kind == "in" else [*w[:i], *w[i + 1 :]] if kind == "out" else [*w[:i], "quite", *w[i + 1 :]] if kind == "word" else w
    return " ".join(w).lower() if kind == "lower" else " ".join(w)


def test_join_equals_brute_force_and_finds_planted_edits(spark):
    rng = random.Random(12)
    items = []
    for i in range(60):
        w = words(rng, rng.randint(9, 40))
        w[rng.randrange(1, len(w))] = str(rng.randint(2, 99))
        w[rng.randrange(1, len(w))] = "Anna"
        items.append((i, " ".join(w)))
    rows = []
    for k in range(400):
        body = words(rng, rng.randint(5, 120))
        at = rng.randrange(len(body))
        rows.append((k, " ".join([*body[:at], edited(rng, items[k % 60][1]), *body[at:]]) if k % 2 else " ".join(body)))
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    index, lexicon = decontaminate.Index(items), decontaminate.Lexicon()
    assert sorted(tuple(r) for r in found) == sorted((k, *leak) for k, t in rows for leak in index.leaks(t.split(), lexicon))
    planted, got = {(k, k % 60) for k in range(1, 400, 2)}, {(r.doc_id, r.item_id) for r in found}
    assert got <= planted and len(got) >= 0.95 * len(planted)


def test_words_read_in_arrays_equal_those_read_one_by_one():
    rng = random.Random(1)
    alphabet = "abzAZéÉßÿÀ×÷ñÑ.,!?:;\"')%$€_-+19½²ΩωжЖ漢"
    text = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(20000)] + ["I", "A", "a", "twenty", "Twenty.", "kg", "KG", "kg.", "ÉTÉ", "Été", "été", "STRASSE", "Straße."]
    lexicon = decontaminate.Lexicon()
    token, flag, at = lexicon.tokens(text)
    read = [lexicon.read(w) for w in text]
    assert at.tolist() == [i for i, (_, f) in enumerate(read) if not f & decontaminate.IS_EMPTY]
    assert flag.tolist() == [read[i][1] for i in at] and token.tolist() == decontaminate.hashes_of([read[i][0] for i in at]).tolist()
