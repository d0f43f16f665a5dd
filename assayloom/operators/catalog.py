"""Catalogues of image files: typed fields from name templates, groups of intensity and mask files, queries on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.strings import basename, digits_to_int, natural_key, template_fields, well_row
from assayloom.operators.aggregate import group_sizes
from assayloom.operators.relational import longer, null_safe_join


def parse_files(files: DataFrame, intensity: str, mask: str | None = None, path: str = "path") -> DataFrame:
    """path, type (intensity or mask) and a column per field (text), with the whole number of all-digit fields in
    <field>_n. Files that match neither template go. The mask's template is tried first."""
    fields = template_fields(F.col(path), intensity)
    masks = template_fields(F.col(path), mask) if mask else {}
    is_mask = next(iter(masks.values())).isNotNull() if masks else F.lit(False)
    is_image = next(iter(fields.values())).isNotNull()
    names = list(dict.fromkeys([*fields, *masks]))
    none = F.lit(None).cast("string")
    out = files.withColumns({"type": F.when(is_mask, "mask").when(is_image, "intensity")} | {n: F.when(is_mask, masks.get(n, none)).otherwise(fields.get(n, none)) for n in names})
    return out.where("type IS NOT NULL").withColumns({f"{n}_n": digits_to_int(F.col(n)) for n in names})


def image_groups(records: DataFrame, by: list[str]) -> DataFrame:
    """Per group: sorted lists of (channel, path) of its intensity and mask files."""
    rows = F.struct("channel", "path")
    return records.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("type") == "intensity", rows))).alias("intensities"), F.array_sort(F.collect_list(F.when(F.col("type") == "mask", rows))).alias("masks"))


def channel_stack(groups: DataFrame) -> DataFrame:
    """Files of a group in order: channels, then masks; with their index."""
    both = F.concat(F.col("intensities"), F.col("masks"))
    keys = [c for c in groups.columns if c not in ("intensities", "masks")]
    out = groups.select(*keys, F.size("intensities").alias("_n"), F.posexplode(both).alias("index", "_f"))
    return out.select(*keys, "index", F.when(F.col("index") < F.col("_n"), "intensity").otherwise("mask").alias("type"), "_f.channel", "_f.path")


def add_metadata(groups: DataFrame, meta: DataFrame, on: list[str]) -> DataFrame:
    return null_safe_join(groups, meta, on)


def find_files(records: DataFrame, **criteria: object) -> DataFrame:
    for k, v in criteria.items():
        records = records.where(F.col(k).isin(*v) if isinstance(v, list | tuple | set) else F.col(k).eqNullSafe(F.lit(v)))
    return records


def unique_values(records: DataFrame, field: str) -> DataFrame:
    return records.select(field).where(F.col(field).isNotNull()).distinct().orderBy(natural_key(F.col(field)))


def by_index(records: DataFrame, order: list[str], index: int) -> DataFrame:
    """The row of a 0-based place."""
    return records.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).where(F.col("_k") == index + 1).drop("_k")


def catalog_summary(records: DataFrame, by: list[str]) -> DataFrame:
    return group_sizes(records, by, ["type"])


def value_index(records: DataFrame, fields: list[str], path: str = "path") -> DataFrame:
    """field, value and its files."""
    return longer(records.select(path, *[F.col(f).cast("string") for f in fields]), [path], fields, "field", "value").where("value IS NOT NULL").groupBy("field", "value").agg(F.array_sort(F.collect_set(path)).alias("paths"))


def folder_labels(files: DataFrame, include: str | None = None, exclude: str | None = None, path: str = "path") -> DataFrame:
    """label (the parent folder) and its 0-based index in natural order; patterns must match at the start of the path."""
    if include:
        files = files.where(F.col(path).rlike("^(?:" + include + ")"))
    if exclude:
        files = files.where(~F.col(path).rlike("^(?:" + exclude + ")"))
    out = files.withColumn("label", F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]+$", 1))
    return out.withColumn("idx", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(natural_key(F.col("label")))) - 1)


def term_genes(annotation: DataFrame, term: str, key: str = "go_id", gene: str = "symbol") -> DataFrame:
    """Distinct genes of a term in a table of annotations."""
    return annotation.where(F.col(key) == term).select(gene).where(F.col(gene).isNotNull()).distinct()


def row_class(well: Column, classes: dict[str, str]) -> Column:
    """Class by the row letter of a well."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), well_row(well))


def channels_wide(records: DataFrame, ids: list[str], channels: list[str]) -> DataFrame:
    return records.groupBy(*ids).pivot("channel", channels).agg(F.first("path"))


def sample_sheet(files: DataFrame, path: str = "path") -> DataFrame:
    """sample, fq1, fq2 from first-of-pair FASTQ names; 'NA' where the mate is missing."""
    from assayloom.functions.strings import mate_file

    first = files.withColumns({"_base": basename(F.col(path)), "_mate": mate_file(F.col(path))}).where("_mate IS NOT NULL")
    have = files.select(F.col(path).alias("_have"))
    out = first.join(have, first["_mate"] == have["_have"], "left")
    return out.select(F.regexp_replace("_base", r"(_S[0-9]+)?(_L[0-9]{3})?(_R1|_1)(_001)?\.(fq|fastq)(\.gz)?$", "").alias("sample"), F.col(path).alias("fq1"), F.coalesce("_have", F.lit("NA")).alias("fq2"))
