"""Functions on DNA and protein strings, all in column expressions but the affine alignment."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Amino acids of the codons in the order T, C, A, G of each base.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(("".join(c) for c in itertools.product("TCAG", repeat=3)), AMINO, strict=True))
#: Three-letter names of the residues.
RESIDUES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
#: Recognition sites and the place of the cut in them.
ENZYMES = {"BsmBI": ("CGTCTC", 7), "BsaI": ("GGTCTC", 7), "EcoRI": ("GAATTC", 1), "BamHI": ("GGATCC", 1), "HindIII": ("AAGCTT", 1), "NotI": ("GCGGCCGC", 2), "XhoI": ("CTCGAG", 1), "NheI": ("GCTAGC", 1), "KpnI": ("GGTACC", 5), "AgeI": ("ACCGGT", 1)}
BASES = "ACGT"


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def revcomp(s: Column) -> Column:
    return F.translate(F.reverse(s), "ACGTacgt", "TGCAtgca")


def gc(s: Column) -> Column:
    """Share of G and C; null for an empty string."""
    return F.try_divide(F.length(F.regexp_replace(F.upper(s), "[^GC]", "")).cast("double"), F.length(s).cast("double"))


def homopolymer(s: Column, n: int = 3, strict: bool = False) -> Column:
    """Whether a base runs n times or more (strict: more than n times)."""
    k = n + 1 if strict else n
    return F.upper(s).rlike("|".join(b * k for b in BASES))


def excluded(s: Column, pattern: str = "ATG|TAA|TGA|TAG") -> Column:
    return F.upper(s).rlike(pattern)


def fuzzy(s: str, motif: str, most: int = 1) -> Column:
    """Whether the motif occurs in a column with at most so many letters changed."""
    n, up = len(motif), f"upper({s})"
    changed = f"aggregate(sequence(1, {n}), 0, (d, j) -> d + IF(substring({up}, i + j, 1) = substring('{motif.upper()}', j, 1), 0, 1))"
    return F.expr(f"length({s}) >= {n} AND exists(sequence(0, greatest(length({s}) - {n}, 0)), i -> {changed} <= {most})")


def entropy(s: Column) -> Column:
    """Shannon entropy of the base composition, in bits."""
    parts = []
    for b in BASES:
        p = F.try_divide(F.length(F.regexp_replace(F.upper(s), f"[^{b}]", "")).cast("double"), F.length(s).cast("double"))
        parts.append(F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    return sum(parts[1:], parts[0])


def hairpin(s: str) -> Column:
    """Length of the longest common substring of a column and its reverse complement."""
    rc = f"translate(reverse({s}), 'ACGT', 'TGCA')"
    return F.expr(f"aggregate(sequence(1, length({s})), 0, (best, l) -> IF(exists(sequence(1, length({s}) - l + 1), i -> instr({rc}, substring({s}, i, l)) > 0), l, best))")


def hamming(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with(split({a}, ''), split({b}, ''), (x, y) -> IF(x <=> y, 0, 1)), 0, (s, d) -> s + d)")


def to_int(s: str) -> Column:
    """2 bits a base (A0 C1 G2 T3), the first base lowest."""
    return F.expr(f"aggregate(split(reverse({s}), ''), 0L, (acc, c) -> acc * 4 + CAST(instr('ACGT', c) - 1 AS BIGINT))")


def from_int(code: str, n: int) -> Column:
    return F.expr(f"array_join(transform(sequence(0, {n} - 1), i -> substring('ACGT', CAST((shiftright({code}, CAST(2 * i AS INT)) & 3) + 1 AS INT), 1)), '')")


def translate_dna(s: str) -> Column:
    """Amino acids of a coding sequence; '*' is stop, X an unknown codon; an incomplete codon at the end is left out."""
    table = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in CODONS.items()) + ")"
    return F.expr(f"IF(length({s}) < 3, '', array_join(transform(sequence(1, length({s}) - 2, 3), i -> coalesce(element_at({table}, substring(upper({s}), i, 3)), 'X')), ''))")


def strip_stop(protein: Column) -> Column:
    return F.regexp_replace(protein, r"\*$", "")


def one_letter(residue: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(RESIDUES), F.upper(residue)), F.lit("X"))


def piece_sql(length: str, i: str, k: int) -> tuple[str, str]:
    """Start and width of the i-th of k pieces of a string of so many letters; widths differ by one at most."""
    return f"(({i}) * ({length}) div {k})", f"((({i}) + 1) * ({length}) div {k} - ({i}) * ({length}) div {k})"


def kmer_windows(s: str, k: int) -> Column:
    """(size, pos, kmer) blocks for a search within distance k - 1: for each length that a string so near can have, the
    places where its k pieces can stand in this one, so that two strings with fewer than k edits share one with the
    other's ``piece_blocks``. An untouched piece is off by d places after at least abs(d) edits, and those behind it make
    up the rest of the difference in length; the first one stands at the start, the last one at the end. A string of
    fewer than k letters has empty pieces, which all strings of a length near to its own share."""
    start, w = piece_sql("l", "i", k)
    places = f"filter(sequence(-({k} - 1), {k} - 1), d -> abs(d) + abs(length({s}) - l - d) < {k} AND (i > 0 OR d = 0) AND (i < {k} - 1 OR d = length({s}) - l))"
    return F.expr(
        f"array_distinct(flatten(flatten(transform(sequence(greatest(length({s}) - ({k} - 1), 0), length({s}) + {k} - 1), l -> transform(sequence(0, {k} - 1), i -> transform({places}, d -> "
        f"named_struct('size', l, 'pos', i, 'kmer', IF({start} + d < 0, '', substring({s}, CAST({start} AS INT) + d + 1, CAST({w} AS INT)))))))))"
        f")"
    )


def piece_blocks(s: str, k: int) -> Column:
    """The k pieces of a string themselves, with its length: (size, pos, kmer)."""
    start, w = piece_sql(f"length({s})", "i", k)
    return F.expr(f"transform(sequence(0, {k} - 1), i -> named_struct('size', length({s}), 'pos', i, 'kmer', substring({s}, CAST({start} AS INT) + 1, CAST({w} AS INT))))")


def split_by_sequence(dna: Column, marker: str) -> tuple[Column, Column, Column]:
    """Left, right and whether the marker occurs exactly once; null parts if it doesn't."""
    up, m = F.upper(dna), marker.upper()
    once = (F.length(up) - F.length(F.replace(up, F.lit(m), F.lit("")))) == len(m)
    at = F.instr(up, m)
    return F.when(once, F.substring(dna, F.lit(1), at - 1)), F.when(once, F.substring(dna, at + len(m), F.length(dna))), once


def split_by_enzyme(dna: Column, enzyme: str) -> tuple[Column, Column]:
    """Both parts at the cut of an enzyme whose site occurs once."""
    site, cut = ENZYMES[enzyme]
    left, _, once = split_by_sequence(dna, site)
    return F.when(once, F.substring(dna, F.lit(1), F.length(left) + cut)), F.when(once, F.substring(dna, F.length(left) + cut + 1, F.length(dna)))


def reverse_translate(protein: str, key: str, weights: dict[str, list[tuple[str, float]]]) -> Column:
    """A codon for each residue by its weights; the draw is the md5 of key and place, so it can be repeated."""
    rows = []
    for aa, codons in sorted(weights.items()):
        total, upto, arms = sum(w for _, w in codons), 0.0, ""
        for codon, w in codons:
            upto += w / total
            arms += f" WHEN u <= {upto + 1e-12} THEN '{codon}'"
        rows.append(f"WHEN a = '{aa}' THEN (CASE{arms} ELSE '{codons[-1][0]}' END)")
    draw = f"CAST(conv(substring(md5(concat({key}, ':', i)), 1, 8), 16, 10) AS DOUBLE) / 4294967296D"
    pick = f"element_at(transform(array({draw}), u -> CASE {' '.join(rows)} ELSE 'NNN' END), 1)"
    return F.expr(f"array_join(transform(split({protein}, ''), (a, i) -> {pick}), '')")


def even_codons() -> dict[str, list[tuple[str, float]]]:
    """Every codon of a residue with the same weight."""
    out: dict[str, list[tuple[str, float]]] = {}
    for codon, aa in CODONS.items():
        out.setdefault(aa, []).append((codon, 1.0))
    return out


def affine_score(a: str, b: str, match: float = 2, mismatch: float = -1, start: float = -0.5, extend: float = -0.1) -> float:
    """Global alignment score; a gap costs ``start`` for its first base and ``extend`` for each further one."""
    low = -1e18
    n = len(b)
    m, x, y = np.full(n + 1, low), np.full(n + 1, low), np.full(n + 1, low)
    m[0] = 0
    y[1:] = start + extend * np.arange(n)
    letters = np.array(list(b))
    for i, c in enumerate(a, 1):
        m2, x2 = np.full(n + 1, low), np.maximum(np.maximum(m, y) + start, x + extend)
        m2[1:] = np.maximum(np.maximum(m[:-1], x[:-1]), y[:-1]) + np.where(letters == c, match, mismatch)
        y2 = np.full(n + 1, low)
        best = np.maximum(m2, x2)
        for j in range(1, n + 1):
            y2[j] = max(best[j - 1] + start, y2[j - 1] + extend)
        m, x, y = m2, x2, y2
    return float(max(m[-1], x[-1], y[-1]))


@pandas_udf(DoubleType())
def alignment_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Affine global alignment of two columns; null if either is."""
    return pd.Series([affine_score(p.upper(), q.upper()) if p is not None and q is not None else None for p, q in zip(a, b, strict=True)], dtype="float64")
