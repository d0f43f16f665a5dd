"""Plates: grids to wells, reader blocks, stage positions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.functions.strings import well_name
from assayloom.operators.windows import serpentine

#: Rows and columns of the plate types by number of wells.
SHAPES = {24: (4, 6), 48: (6, 8), 96: (8, 12), 384: (16, 24)}
#: Fixed values of the plate types: rows, columns, distance of the wells in x and y, diameter of a well, x and y of A1,
#: stage height, focus height; then the directions of x and y. Micrometres.
PLATE_TYPES = {
    "CellVis_P96_RM384": (8, 12, 9000, 9000, 6000, -35062, 35202, 5334, 7200, 1, -1),
    "CellVis_P24_RM384": (4, 6, 19300, 19300, 15540, -32748, 32633, 4284, 7200, 1, -1),
    "Phenoplate_P384": (16, 24, 4500, 4500, 3200, 98554, 3966, 3721, 9020, -1, 1),
    "Phenoplate_P96": (8, 12, 9000, 9000, 6000, 96412, 6284, 3788, 9020, -1, 1),
    "CellVis_P384": (16, 24, 4500, 4500, 3200, 93275, 6170, 5512, 11765, -1, 1),
    "CellVis_P96": (8, 12, 9000, 9000, 6000, 96290, 5089, 5334, 8720, -1, 1),
    "CellVis_P24": (4, 6, 19300, 19300, 15540, 93586, 7410, 4284, 8650, -1, 1),
    "CellVis_C18": (3, 6, 7560, 7140, 5650, 98195, 28913, 3674, 8738, -1, 1),
    "CellVis_C8": (2, 4, 11570, 11200, 8700, 95795, 31775, 3683, 8675, -1, 1),
}
PLATE_FIELDS = "name string, n_row int, n_col int, well_interval_x double, well_interval_y double, well_diameter double, a1_x double, a1_y double, pos_z double, pos_pfs double, x_direct int, y_direct int"


def plate_layout(grid: DataFrame, format: str = "wide", prefix: str = "", sheets: list[str] | None = None) -> DataFrame:
    """Grid cells (sheet, row, col, value) to wells. long: (sheet, well, value) of the filled ones; wide: a column per sheet,
    wells with any value."""
    long = grid.where("value IS NOT NULL AND trim(value) <> ''").select("sheet", well_name(F.col("row"), F.col("col")).alias("well"), "value")
    if format == "long":
        return long
    if format != "wide":
        raise ValueError("format must be wide or long")
    names = sheets or [r[0] for r in long.select("sheet").distinct().orderBy("sheet").collect()]
    return long.groupBy("well").pivot("sheet", names).agg(F.first("value")).withColumnsRenamed({n: prefix + n for n in names})


def read_plate_info(grid: DataFrame, directory: str | None = None, prefix: str = "") -> DataFrame:
    """The wide layout, with the folder it came from as a column if asked."""
    wide = plate_layout(grid, "wide", prefix)
    return wide.withColumn("directory", F.lit(directory)) if directory is not None else wide


def read_plate_info_2(grid: DataFrame) -> DataFrame:
    """The long layout by sheet and well."""
    return plate_layout(grid, "long").select("well", F.col("sheet").alias("name"), "value")


def reader_block(cells: DataFrame, wells: int = 96, invert: bool = False, by: list[str] | None = None) -> DataFrame:
    """Wells of a reader's export (sheet, r, c, cell): the block right of the first 'A' in column 1 (rows 1 to 100), as
    numbers; turned by 180 degrees if inverted; empty cells go."""
    by = by or ["sheet"]
    n_row, n_col = SHAPES[wells]
    top = cells.where("c = 1 AND trim(cell) = 'A' AND r <= 100").groupBy(*by).agg(F.min("r").alias("_top"))
    block = cells.join(top, by).withColumns({"_r": F.col("r") - F.col("_top") + 1, "_c": F.col("c") - 1}).where(F.col("_r").between(1, n_row) & F.col("_c").between(1, n_col))
    row, col = (n_row + 1 - F.col("_r"), n_col + 1 - F.col("_c")) if invert else (F.col("_r"), F.col("_c"))
    return block.select(*by, well_name(row, col).alias("well"), F.col("cell").try_cast("double").alias("value")).where("value IS NOT NULL")


def wells_table(spark: SparkSession, n_row: int = 8, n_col: int = 12) -> DataFrame:
    return spark.range(n_row * n_col).select((F.floor(F.col("id") / n_col) + 1).cast("int").alias("row"), (F.col("id") % n_col + 1).cast("int").alias("col")).withColumn("well", well_name(F.col("row"), F.col("col")))


def plate_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *v[:2], *map(float, v[2:9]), *v[9:]) for n, v in PLATE_TYPES.items()], PLATE_FIELDS)


def field_offsets(spark: SparkSession, n: int, view: float, diameter: float, overlap: float = 0.0) -> DataFrame:
    """The n fields of a grid nearest to the well's centre that fit into it: field, dx, dy. Raises if they don't fit."""
    step = view * (1 - overlap)
    side = math.ceil(math.sqrt(n)) + 2
    half = side // 2
    grid = spark.range((2 * half + 1) ** 2).select(((F.col("id") % (2 * half + 1)) - half).alias("i"), (F.floor(F.col("id") / (2 * half + 1)) - half).alias("j"))
    grid = grid.select((F.col("i") * step).alias("dx"), (F.col("j") * step).alias("dy")).withColumn("_d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    inside = grid.where(F.col("_d") + view / 2 <= diameter / 2)
    if inside.count() < n:
        raise ValueError("so many fields don't fit into the well")
    return inside.orderBy("_d", "dy", "dx").limit(n).select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_d", "dy", "dx")).alias("field"), "dx", "dy")


def stage_positions(spark: SparkSession, plate: str, n: int, view: float, order: str = "lr", z: float | None = None) -> DataFrame:
    """PositionID, name (well#field), x, y, z of all wells of a plate type in serpentine order, in the type's directions."""
    n_row, n_col, dx, dy, diameter, a1_x, a1_y, pos_z, _, x_direct, y_direct = PLATE_TYPES[plate]
    w = serpentine(wells_table(spark, n_row, n_col), "row", "col", order)
    both = w.crossJoin(F.broadcast(field_offsets(spark, n, view, diameter)))  # at most 384 wells and a few fields
    x = F.lit(float(a1_x)) + (F.col("col") - 1) * float(dx * x_direct) + F.col("dx")
    y = F.lit(float(a1_y)) + (F.col("row") - 1) * float(dy * y_direct) + F.col("dy")
    out = both.select("visit", "well", "field", x.alias("x"), y.alias("y"), F.lit(float(pos_z if z is None else z)).alias("z"))
    return out.select((F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("visit", "field")) - 1).alias("PositionID"), F.concat_ws("#", "well", "field").alias("name"), "x", "y", "z")
