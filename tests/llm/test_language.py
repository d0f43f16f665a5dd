"""Language ID: held-out accuracy, backoff for unseen words, and edge cases."""

import math
from collections import Counter

from assayloom.llm import language

EN = ["the house and the garden are with them", "this is the way that they went", "with the and of that which"]
DE = ["der garten und das haus sind mit ihnen", "dies ist der weg den sie gingen", "mit der und das die nicht"]


def test_words_first_then_shorter_grams():
    scorer = language.Scorer(language.fit(EN * 3 + DE * 3, ["en"] * 9 + ["de"] * 9))
    assert scorer.score("the garden")[0] == "en"
    assert scorer.score("der haus")[0] == "de"
    assert scorer.score("mitgarten nichtung")[0] == "de"  # unseen words
    assert scorer.score("Zzz")[0] in ("de", "en")
    for empty in (None, "", " 12 -- 3 ", "½ ²"):
        assert scorer.score(empty) == ("und", 0.0)


def test_long_text_and_bounded_memory(monkeypatch):
    monkeypatch.setattr(language, "MEMO", 200_000)
    scorer = language.Scorer(language.fit(EN, ["en"] * 3))
    words = " ".join(f"word{'abcdefghij'[i % 10]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(250_000))
    assert scorer.score(words) == ("en", 1.0)


def test_table(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([(t, "en") for t in EN * 8] + [(t, "de") for t in DE * 8])] + [(100, None, "en"), (101, "", None), (None, "the and", None), (7, "the and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "9 as score", "'x' as _text", "'y' as lang_pred")
    found = language.identify(docs, language.train(docs)).collect()
    kept = language.identify(docs, language.train(docs), keep=["_text", "text", "doc_id"])
    assert kept.columns == ["_text", "text", "doc_id", "lang_pred", "score"] and {r._text for r in kept.collect()} == {"x"}
    assert len(found) == len(rows) and found[0].asDict().keys() == {"doc_id", "lang_pred", "score"}
    by = {r.doc_id: r.lang_pred for r in found}
    assert by[100] == by[101] == "und" and by[None] == "en"
    right = sum(by[i] == l for i, _, l in rows[:48])
    assert right >= 46
    empty = docs.limit(0)
    assert language.identify(empty, language.train(empty)).count() == 0
    nothing = docs.withColumn("lang", language.F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(nothing, language.train(nothing)).collect()} == {"und"}


def test_scores_equal_brute_force():
    """Words first, else the longest known n-grams, by plain dictionaries."""
    texts, langs = [*EN, *DE, "हिन्दी में लिखा गया है", "漢字を書く"] * 2, ["en"] * 3 + ["de"] * 3 + ["hi", "ja"] + ["en"] * 3 + ["de"] * 3 + ["hi", "ja"]
    model = language.fit(texts, langs)
    names = sorted(set(langs))
    words: dict = {}
    for t, x in zip(texts, langs, strict=True):
        for w in language.words_of(t):
            words.setdefault(w, Counter())[x] += 1
    grams: dict = {}
    for w, c in words.items():
        for n in range(1, 6):
            for i in range(len(w) + 3 - n):
                grams.setdefault(f" {w} "[i : i + n], Counter()).update(c)
    known = {w: c for w, c in words.items() if sum(c.values()) >= 2}
    kept = {g: c for g, c in grams.items() if sum(c.values()) >= 3 and g != " "}

    def row(c, group):
        p = [(c[x] + 0.5) / (sum(o[x] for o in group) + 1) for x in names]
        return [math.log(v / sum(p)) for v in p]

    def brute(text):
        total = [0.0] * len(names)
        for w in language.words_of(text):
            if w in known:
                rows = [row(known[w], known.values())]
            else:
                rows = next((found for n in range(5, 0, -1) if (found := [row(kept[g], [c for k, c in kept.items() if len(k) == n]) for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) in kept])), [[0.0] * len(names)])
            total = [t + sum(r[i] for r in rows) / len(rows) for i, t in enumerate(total)]
        top = max(total)
        return names[total.index(top)], 1 / sum(math.exp(t - top) for t in total)

    scorer = language.Scorer(model)
    for text in ("the garden und gehen", "hausgarten", "हिन्दी", "漢 xyz", "whichever zusammen qqq", *texts):
        lang, score = scorer.score(text)
        want = brute(text)
        assert lang == want[0] and abs(score - want[1]) < 1e-4, (text, lang, score, want)


def test_words_keep_their_marks():
    assert language.words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"] and language.words_of("漢字ab12cd") == ["漢", "字", "ab", "cd"]
    assert language.words_of("Don't ÉTÉ naïve") == ["don", "t", "été", "naïve"]


def test_forgetting_changes_nothing(monkeypatch):
    model = language.fit(EN, ["en"] * 3)
    text = " ".join(f"{a}{b}" for a in "qwertyuiop" for b in ("the", "and", "of", "in", "that")) * 3
    want = language.Scorer(model).score(text)
    monkeypatch.setattr(language, "MEMO", 7)
    monkeypatch.setattr(language, "BLOCK", 40)
    got = language.Scorer(model).score(text)
    assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-6


def test_more_languages_than_the_bound(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} alpha", f"l{i % 30:02d}") for i in range(300)], "doc_id long, text string, lang string")
    assert len(language.train(docs, bound=10).langs) == 10
