"""Scalar functions on labels, wells, file names and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def well_style(w: Column) -> Column:
    """A01 to A1."""
    return F.regexp_replace(w, "^([A-Za-z]+)0+", "$1")


def well_name(row: Column, col: Column) -> Column:
    """Letter and number from 1-based row and column (rows beyond Z double the letter: AA, AB)."""
    r = row.cast("int") - 1
    one = F.char(F.lit(65) + r % 26)
    return F.concat(F.when(r >= 26, F.char(F.lit(64) + (r / 26).cast("int"))).otherwise(F.lit("")), one, col.cast("int").cast("string"))


def well_row(w: Column) -> Column:
    return F.nullif(F.regexp_extract(w, "^([A-Za-z]+)", 1), F.lit(""))


def well_col(w: Column) -> Column:
    return F.regexp_extract(w, "([0-9]+)$", 1).try_cast("int")


def natural_key(x: Column) -> Column:
    """Sort key of labels with numbers: letters, then the number's value."""
    return F.struct(F.regexp_extract(x, "^([^0-9]*)", 1), F.regexp_extract(x, "([0-9]+)", 1).try_cast("long"), x)


def basename(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/\\]+)[/\\]*$", 1)


def dirname(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)[/\\][^/\\]+[/\\]*$", 1)


def stem(p: Column, suffix: str = r"\.[^.]+") -> Column:
    """Base name without its extension."""
    return F.regexp_replace(basename(p), suffix + "$", "")


def norm_path(p: Column) -> Column:
    """Forward slashes; C:\\x becomes /mnt/c/x."""
    fwd = F.regexp_replace(p, r"\\", "/")
    drive = F.lower(F.regexp_extract(fwd, "^([A-Za-z]):/", 1))
    return F.when(drive != "", F.concat(F.lit("/mnt/"), drive, F.lit("/"), F.regexp_replace(fwd, "^[A-Za-z]:/", ""))).otherwise(fwd)


def template_regex(template: str) -> tuple[str, list[str]]:
    """``{a}_t{b}.tiff`` as a regular expression and its field names."""
    names = re.findall(r"\{(\w+)\}", template)
    parts = re.split(r"\{\w+\}", template)
    return "^" + r"([^_./\\]+)".join(re.escape(p) for p in parts) + "$", names


def template_fields(path: Column, template: str) -> dict[str, Column]:
    """A column for each field of a file name template; null where the name doesn't match."""
    pattern, names = template_regex(template)
    name = basename(path)
    return {n: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, i)) for i, n in enumerate(names, 1)}


def digits_to_int(x: Column) -> Column:
    """The number of an all-digit label, else null."""
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))


def unversioned(gene: Column) -> Column:
    """Identifier without its version: ENSG01.12 to ENSG01."""
    return F.split(gene, "[.]")[0]


def read_id(header: Column) -> Column:
    """FASTQ header without mate marks: leading @, text after white space, /1, .1 and _1 at the end."""
    bare = F.split(F.regexp_replace(header, "^@", ""), r"\s+")[0]
    return F.regexp_replace(bare, "[/._][12]$", "")


def read_mate(header: Column) -> Column:
    """Mate number 1 or 2 from ' 1:N:0', '/1', '.1' or '_1'; null if there is none."""
    found = F.regexp_extract(header, r"\s([12]):[YN]:", 1)
    other = F.regexp_extract(F.split(header, r"\s+")[0], "[/._]([12])$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(other, F.lit(""))).cast("int")


def mate_file(name: Column) -> Column:
    """Name of the second file of a pair, by R1/R2 or _1/_2; null if the name isn't a first file."""
    r = F.when(name.rlike("_R1([_.])"), F.regexp_replace(name, "_R1([_.])", "_R2$1"))
    return F.coalesce(r, F.when(name.rlike(r"_1\.(fq|fastq)"), F.regexp_replace(name, r"_1\.(fq|fastq)", "_2.$1")))


def fraction(x: Column) -> Column:
    """Value of '12/340'."""
    p = F.split(x, "/")
    return F.try_divide(F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double"))


def format_auto(x: Column, accuracy: float = 0.01) -> Column:
    """Scientific form below the accuracy, plain otherwise."""
    digits = max(0, len(f"{accuracy:.10f}".rstrip("0").partition(".")[2]))
    return F.when(F.abs(x) < accuracy, F.format_string("%.2e", x)).otherwise(F.format_string(f"%.{digits}f", x))


def sentence_case(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def pad(x: Column, width: int, fill: str = " ", left: bool = True) -> Column:
    """Filled up to a width; longer strings stay whole."""
    short = F.length(x) < width
    return F.when(short, F.lpad(x, width, fill) if left else F.rpad(x, width, fill)).otherwise(x)


def squish(x: Column) -> Column:
    """Without white space at the ends, one space for each run inside."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def collection_parts(term: Column) -> tuple[Column, Column]:
    """Category and description of 'COLLECTION_REST_OF_NAME'."""
    p = F.split(term, "_", 2)
    return F.get(p, F.lit(0)), sentence_case(F.regexp_replace(F.get(p, F.lit(1)), "_", " "))


def best_match(choices: list[str], patterns: list[str]) -> str:
    """First choice that matches the pattern of highest priority; the first choice if none does; '' without choices."""
    for p in patterns:
        for c in choices:
            if re.search(p, c, re.IGNORECASE):
                return c
    return choices[0] if choices else ""


def number_type(x: Column) -> Column:
    """Display text: integers plain, other numbers with three decimals, null as NA."""
    return F.when(x.isNull(), "NA").when(x == F.floor(x), F.format_string("%d", x.cast("long"))).otherwise(F.format_string("%.3f", x))
