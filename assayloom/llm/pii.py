"""Personal data by weak supervision, in DataFrame functions only.

1. Candidates: the base patterns (email, ip, card, phone) and looser ones (bracketed addresses, phone numbers without a
   country code, national ids, account numbers), each with its place, the text left and right of it.
2. Five labelers vote on every candidate: strict form, usual shape, gazetteer, context words, clean borders.
3. The candidates are counted by kind, votes and form (at most 384 patterns of votes times 80 forms, whatever the input);
   expectation-maximisation over those counts estimates each labeler's reliability by kind and the odds of each pattern.
4. A logistic span classifier over form and context features is trained on the estimated odds, again over counts.
5. Base matches that pass their checks are always spans; looser candidates are where the classifier says so.

Patterns that search runs start only at the border of a run (or where the last match ended), so a long run without a
match is read once, not once for each of its places.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.session import materialize

BASE = ("email", "ip", "card", "phone")
EXTRA = ("mailto", "local", "ssn", "iban")
KINDS = BASE + EXTRA
#: Java patterns by kind. Base ones find the leftmost non-overlapping matches of the plain pattern.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "mailto": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63}){1,5}",
    "local": r"(?<![0-9+.-])(?<![0-9][ )])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[ .-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What a text must contain for a kind to be searched in it.
GUARDS = {
    "email": "contains({t}, '@')",
    "ip": "rlike({t}, r'[0-9][.][0-9]')",
    "card": "rlike({t}, r'[0-9][ -]?[0-9]')",
    "phone": "contains({t}, '+')",
    "mailto": "rlike({t}, r'[\\[(]at[\\])]')",
    "local": "rlike({t}, r'[0-9]{3}[ .-][0-9]{4}')",
    "ssn": "rlike({t}, r'-[0-9]{2}-')",
    "iban": "rlike({t}, r'[A-Z]{2}[0-9]{2}')",
}
LEFT, RIGHT = 32, 12

# Fixed values of the labelers.
TLDS = "com|org|net|edu|gov|io|info|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|co|biz"
DIAL = "1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|3[578][0-9]|42[0-9]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|62"
GOOD_WORDS = "e-?mail|mail|contact|write|reach|phone|tel|telephone|call|fax|mobile|cell|card|visa|credit|pay|debit|ip|host|server|client|login|user|address|ssn|social|iban|account|customer|patient|name"
BAD_WORDS = "version|release|build|page|section|figure|table|isbn|chapter|serial|part|item|order|lines?|price"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
VOTES = ("strict", "shape", "gazetteer", "context", "border")


def luhn_sql(digits: str) -> str:
    """Whether a string of digits passes the Luhn check."""
    value = f"CAST(substring({digits}, length({digits}) - i, 1) AS INT)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + IF(i % 2 = 0, {value}, 2 * {value} - IF({value} > 4, 9, 0))) % 10 = 0"


def strict_sql(kind: str, m: str) -> str:
    """Check of a match; for base kinds, what the match must pass."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"rlike({m}, r'^{OCTET}(?:[.]{OCTET}){{3}}$')",
        "card": f"(length({digits}) BETWEEN 16 AND 19) AND ({luhn_sql(digits)})",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "mailto": f"rlike({m}, r'(?i)[a-z].*(?:[.]|dot[\\])]) ?(?:{TLDS})$')",
        "local": f"rlike({m}, r'^[(]?[2-9]')",
        "ssn": f"rlike({m}, r'^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)')",
        "iban": f"length(replace({m}, ' ', '')) BETWEEN 15 AND 34",
    }[kind]


def shape_sql(kind: str, m: str) -> str:
    return {
        "email": f"rlike({m}, r'[A-Za-z].*@.*[A-Za-z]{{2}}$')",
        "ip": f"NOT rlike({m}, r'(^|[.])0[0-9]')",
        "card": f"rlike({m}, r'^[0-9]{{16,19}}$|^[0-9]{{4}}([ -][0-9]{{4}}){{3}}')",
        "phone": f"rlike({m}, r'^[+][0-9]{{1,3}}[ .-]?[(]?[0-9]{{1,4}}')",
        "mailto": f"rlike({m}, r'dot')",
        "local": f"rlike({m}, r'^[(]|-')",
        "ssn": "true",
        "iban": f"rlike({m}, r'^[A-Z]{{2}}[0-9]{{2}}(?: [A-Z0-9]{{4}})+|^[A-Z]{{2}}[0-9]{{12,}}$')",
    }[kind]


def gazetteer_sql(kind: str, m: str) -> str:
    return {
        "email": f"rlike({m}, r'(?i)[.](?:{TLDS})$')",
        "ip": f"NOT rlike({m}, r'^(?:0|127|255|22[4-9]|2[3-5][0-9])[.]')",
        "card": f"rlike({m}, r'^(?:{ISSUERS})')",
        "phone": f"rlike({m}, r'^[+](?:{DIAL})')",
        "mailto": f"rlike({m}, r'(?i)(?:{TLDS})$')",
        "local": f"rlike({m}, r'^[(]?[2-9][0-8][0-9]')",
        "ssn": f"rlike({m}, r'^[0-8]')",
        "iban": f"rlike({m}, r'^(?:DE|FR|ES|GB|IT|NL|CH|AT|BE|LU|IE|PT|PL|SE|DK|FI|NO)')",
    }[kind]


#: Elements that a running sum or maximum copies at a time; it takes time in proportion to the array's length, and to the
#: square of its number of blocks, which is small.
SCAN = 256


def running_sql(values: str, op: str) -> str:
    """SQL of the sum (``+``) or maximum (``greatest``) of all values before each, for an array of integers; 0 at first."""
    both = "{0} + {1}" if op == "+" else "greatest({0}, {1})"
    inner = (
        f"transform(sequence(0, greatest(size(v) - 1, 0) div {SCAN}), b -> aggregate(slice(v, b * {SCAN} + 1, {SCAN}), named_struct('at', 0, 'out', CAST(array() AS ARRAY<INT>)), "
        f"(a, x) -> named_struct('at', {both.format('a.at', 'x')}, 'out', concat(a.out, array(a.at)))))"
    )
    outer = f"aggregate(w, named_struct('at', 0, 'out', CAST(array() AS ARRAY<INT>)), (a, x) -> named_struct('at', {both.format('a.at', 'x.at')}, 'out', concat(a.out, array(a.at))), a -> a.out)"
    joined = f"flatten(zip_with(w, {outer}, (x, o) -> transform(x.out, p -> {both.format('p', 'o')})))"
    return let_sql("v", values, let_sql("w", inner, joined))


def let_sql(name: str, value: str, body: str) -> str:
    """SQL in which a value has a name, so that it is computed once and not once for each element that reads it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def candidates_sql(column: str, kind: str) -> str:
    """SQL of the array of candidates of a kind in a column with ``found`` (matches) and ``pieces`` (what is between)."""
    m, left, right = "c.m", "c.l", "c.r"
    sizes = f"zip_with({column}.found, slice({column}.pieces, 1, size({column}.found)), (m, q) -> length(m) + length(q))"
    ends = f"zip_with({running_sql(sizes, '+')}, slice({column}.pieces, 1, size({column}.found)), (at, q) -> named_struct('s', at + length(q), 'l', right(q, {LEFT})))"
    begun = f"zip_with({column}.found, {ends}, (m, x) -> named_struct('s', x.s, 'm', m, 'l', x.l))"
    place = f"zip_with({begun}, slice({column}.pieces, 2, size({column}.found)), (x, q) -> named_struct('s', x.s, 'm', x.m, 'l', x.l, 'r', left(q, {RIGHT})))"
    vote = lambda test: f"IF({test}, 1, -1)"
    context = f"CASE WHEN rlike({left}, r'(?i)(?:^|[^a-z])(?:{GOOD_WORDS})[^a-z]{{1,4}}(?:is |at |no |number )?[^a-z]{{0,3}}$') THEN 1 WHEN rlike({left}, r'(?i)(?:^|[^a-z])(?:{BAD_WORDS})[^a-z]{{1,4}}$') THEN -1 ELSE 0 END"
    border = vote(f"NOT rlike({left}, r'[A-Za-z0-9_/=]$') AND NOT rlike({right}, r'^[A-Za-z0-9_/=]')")
    strict = f"({strict_sql(kind, m)})"
    return (
        f"CASE WHEN size({column}.found) > 0 THEN transform({place}, c -> named_struct('kind', '{kind}', 's', c.s, 'e', c.s + length({m}), "
        f"'strict', {vote(strict)}, 'shape', {vote(shape_sql(kind, m))}, 'gazetteer', {vote(gazetteer_sql(kind, m))}, 'context', {context}, 'border', {border}, "
        f"'size', least(length({m}) div 4, 9), 'spaced', rlike({m}, '[ ]'), 'dashed', rlike({m}, '-'), 'newline', {left} = '' OR rlike({left}, r'[\\n]$'))) ELSE {EMPTY} END"
    )


FIELDS = "kind: STRING, s: INT, e: INT, strict: INT, shape: INT, gazetteer: INT, context: INT, border: INT, size: INT, spaced: BOOLEAN, dashed: BOOLEAN, newline: BOOLEAN"
EMPTY = f"CAST(array() AS ARRAY<STRUCT<{FIELDS}>>)"


def find_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and ``found``: candidates of all kinds, by kind as listed, then start."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    nothing = F.expr("named_struct('found', CAST(array() AS ARRAY<STRING>), 'pieces', CAST(array() AS ARRAY<STRING>))")
    cut = {}
    for kind in KINDS:
        matches = F.regexp_extract_all("_t", F.lit(PATTERNS[kind]), F.lit(0))
        pieces = F.struct(matches.alias("found"), F.split("_t", PATTERNS[kind], -1).alias("pieces"))
        cut[f"_{kind}"] = F.when(F.expr(GUARDS[kind].replace("{t}", "_t")), pieces).otherwise(nothing)
    rows = rows.select("doc_id", *[c.alias(k) for k, c in cut.items()])
    listed = ", ".join(candidates_sql(f"_{kind}", kind) for kind in KINDS)
    return rows.select("doc_id", F.expr(f"concat({listed})").alias("found"))


@dataclass
class Model:
    """Reliability of each labeler by kind, share of true candidates by kind, and weights of the span classifier."""

    reliability: dict[tuple[str, str], tuple[float, float]]
    prior: dict[str, float]
    weights: dict[str, float]


def estimate(counts: list[tuple], rounds: int = 30) -> tuple[dict, dict, list[float]]:
    """Expectation-maximisation over counted vote patterns (kind, five votes, n): a labeler says yes for a true candidate
    with one probability and for a false one with another, by kind; both are smoothed towards a useful labeler.

    Returns (kind, labeler) -> both probabilities, kind -> share of true ones, and the odds of each pattern.
    """
    posterior = [min(0.95, max(0.05, (sum(c[1:6]) + 5) / 10)) for c in counts]
    right: dict = {}
    prior: dict = {}
    for _ in range(rounds):
        total: dict = {}
        for c, p in zip(counts, posterior, strict=True):
            n = c[6]
            t = total.setdefault(c[0], [0.0, 0.0])
            t[0] += n * p
            t[1] += n * (1 - p)
        prior = {k: (t + 2.0) / (t + f + 4.0) for k, (t, f) in total.items()}
        yes: dict = {}
        for c, p in zip(counts, posterior, strict=True):
            for name, v in zip(VOTES, c[1:6], strict=True):
                if v:
                    y = yes.setdefault((c[0], name), [8.0, 10.0, 2.0, 10.0])  # yes and all among true, among false
                    y[0] += c[6] * p * (v > 0)
                    y[1] += c[6] * p
                    y[2] += c[6] * (1 - p) * (v > 0)
                    y[3] += c[6] * (1 - p)
        right = {k: (y[0] / y[1], y[2] / y[3]) for k, y in yes.items()}
        for i, c in enumerate(counts):
            z = math.log(prior[c[0]] / (1 - prior[c[0]]))
            for name, v in zip(VOTES, c[1:6], strict=True):
                if v:
                    a, b = right[c[0], name]
                    z += math.log(a / b) if v > 0 else math.log((1 - a) / (1 - b))
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return right, prior, posterior


def features(row: dict) -> list[str]:
    """Names of the features of a candidate."""
    k = row["kind"]
    return ["bias", f"kind={k}", *(f"{k}:{v}={row[v]}" for v in VOTES), f"context={row['context']}", f"border={row['border']}", f"size={row['size']}", *(f"{k}:{b}" for b in ("spaced", "dashed", "newline") if row[b])]


def fit(counted: list[dict], rounds: int = 200) -> Model:
    """Estimate by votes, then train the classifier on the odds; ``counted``: candidates counted by votes and form."""
    patterns: dict = {}
    for row in counted:
        key = (row["kind"], *(row[v] for v in VOTES))
        patterns[key] = patterns.get(key, 0) + row["n"]
    counts = [(*k, n) for k, n in sorted(patterns.items())]
    right, prior, posterior = estimate(counts)
    odds = {c[:6]: p for c, p in zip(counts, posterior, strict=True)}
    rows = sorted((tuple(features(r)), odds[(r["kind"], *(r[v] for v in VOTES))], float(r["n"])) for r in counted)
    weights: dict[str, float] = {f: 0.0 for fs, _, _ in rows for f in fs}
    total = sum(n for *_, n in rows) or 1.0
    speed = dict.fromkeys(weights, 1e-8)
    for _ in range(rounds):
        grad = {f: 1e-4 * w for f, w in weights.items()}
        for fs, p, n in rows:
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in fs))))) - p) * n / total
            for f in fs:
                grad[f] += g
        for f, g in grad.items():
            speed[f] += g * g
            weights[f] -= 0.3 * g / math.sqrt(speed[f])
    return Model(right, prior, weights)


def count_candidates(found: DataFrame) -> list[dict]:
    """Candidates counted by kind, votes and form: a bounded number of rows, however many documents."""
    names = ["kind", *VOTES, "size", "spaced", "dashed", "newline"]
    return [r.asDict() for r in found.select(F.inline("found")).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]


def score_sql(weights: dict[str, float]) -> str:
    """SQL of the classifier's logit of a candidate ``c``."""
    parts = ["0D"]
    for name, w in sorted(weights.items()):
        kind, _, rest = name.rpartition(":")
        key, _, value = (rest or name).partition("=")
        test = [f"c.kind = '{kind}'"] if kind else []
        if key == "bias":
            test.append("true")
        elif key == "kind":
            test.append(f"c.kind = '{value}'")
        elif value:
            test.append(f"c.{key} = {value}")
        else:
            test.append(f"c.{key}")
        parts.append(f"IF({' AND '.join(test)}, {w:.6f}D, 0D)")
    return " + ".join(parts)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``base`` and ``spans``: arrays of (kind, start, end), code points, end exclusive, by kind as listed, then start.

    ``base`` holds the base matches that pass their checks; ``spans`` those and what the classifier adds. Null and empty
    texts have none; repeated rows get the same spans; an empty table gives an empty result; other columns aren't read.
    Texts are searched once: candidates (places, votes and form, no text) are written to the shared folder.
    """
    found = materialize(find_candidates(docs, id_col, text_col), "candidates")
    model = fit(count_candidates(found))
    is_base = f"c.kind IN ({', '.join(repr(k) for k in BASE)})"
    base = f"filter(found, c -> {is_base} AND c.strict = 1)"
    kept = f"filter(found, c -> IF({is_base}, c.strict = 1, ({score_sql(model.weights)}) > 0))"
    slim = "transform({}, c -> named_struct('kind', c.kind, 'start', c.s, 'end', c.e))"
    return found.select(F.col("doc_id").alias(id_col), F.expr(slim.format(base)).alias("base"), F.expr(slim.format(kept)).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({spans}, c -> concat(c.kind, ':', c.start, ':', c.end)), ',')")


#: Characters in a block of a text that is put together anew.
BLOCK = 1024


def gap_sql(blocks: str, start: str, end: str) -> str:
    """SQL of a stretch of a text that is cut into blocks."""
    first, last = f"({start}) div {BLOCK}", f"({end}) div {BLOCK}"
    inside = f"substring({blocks}[CAST({first} AS INT)], ({start}) % {BLOCK} + 1, ({end}) - ({start}))"
    begin = f"substring({blocks}[CAST({first} AS INT)], ({start}) % {BLOCK} + 1)"
    middle = f"array_join(slice({blocks}, CAST({first} AS INT) + 2, CAST({last} - {first} AS INT) - 1), '')"
    finish = f"IF(({end}) % {BLOCK} = 0, '', substring({blocks}[CAST({last} AS INT)], 1, ({end}) % {BLOCK}))"
    return f"CASE WHEN ({start}) >= ({end}) THEN '' WHEN {first} = {last} THEN {inside} ELSE concat({begin}, {middle}, {finish}) END"


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, of the first kind.

    A row travels with its own candidates, so nothing is joined; repeated rows and ids are each redacted alike. Null and
    empty texts stay as they are; all columns stay; an empty table gives an empty result. Texts are searched twice: for the counts that train the classifier, then to replace.
    """
    found = find_candidates(docs.select(F.struct("*").alias("_row"), F.col(text_col)), "_row", text_col)
    model = fit(count_candidates(find_candidates(docs, id_col, text_col)))
    is_base = f"c.kind IN ({', '.join(repr(k) for k in BASE)})"
    kept = f"filter(found, c -> IF({is_base}, c.strict = 1, ({score_sql(model.weights)}) > 0))"
    ordered = f"array_sort(transform({kept}, c -> named_struct('s', c.s, 'e', c.e, 'kind', c.kind)))"
    text = f"doc_id.`{text_col}`"
    # Spans that overlap become one: a span is its own head if it starts where all before it have ended. The text is cut
    # into blocks, so that what stands between two spans is found without counting from the start of the text.
    heads = (
        f"filter(zip_with(spans, {running_sql('transform(spans, c -> c.e)', 'greatest')}, (c, past) -> named_struct('past', past, 's', c.s, 'kind', c.kind)), c -> c.s >= c.past)"
    )
    between = gap_sql("blocks", "c.past", "c.s")
    tail = gap_sql("blocks", "aggregate(spans, 0, (a, c) -> greatest(a, c.e))", "size_")
    cleaned = f"concat(array_join(transform({heads}, c -> concat({between}, '[', upper(c.kind), ']')), ''), {tail})"
    cleaned = let_sql("blocks", f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)", let_sql("size_", f"length({text})", cleaned))
    out = found.select("doc_id", F.expr(ordered).alias("spans"))
    out = out.select("doc_id", F.expr(f"IF(size(spans) = 0, {text}, {cleaned})").alias("_text"))
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"doc_id.`{c}`").alias(c) for c in docs.columns])
