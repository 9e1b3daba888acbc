"""Grids: bounding boxes, templates, regridding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafseason.functions.arithmetic import sentinel_to_null
from leafseason.schema import EMPTY_TEMPLATE

#: (minx, miny, maxx, maxy), or nothing.
Box = tuple[float, float, float, float] | None


def clip(df: DataFrame, bbox: Box, cell: float = 0.0) -> DataFrame:
    """Rows whose cell (centre x, y and width `cell`) meets the box (minx, miny, maxx, maxy); without a box all rows."""
    if bbox is None:
        return df
    minx, miny, maxx, maxy = bbox
    return df.where(F.col("x").between(minx - cell / 2, maxx + cell / 2) & F.col("y").between(miny - cell / 2, maxy + cell / 2))


def template_grid(template: DataFrame, bbox: Box = None, value: str = "seed", cell: float = 0.0) -> DataFrame:
    """The cells of a template, clipped; its empty value becomes NULL, other values seed the bounds."""
    return clip(template, bbox, cell).withColumn(value, sentinel_to_null(F.col(value), EMPTY_TEMPLATE))


def generated_grid(spark, bbox: tuple[float, float, float, float], cell: float) -> DataFrame:
    """(row, col, y, x) of all cells of a box, made by the executors."""
    minx, miny, maxx, maxy = bbox
    cols, rows = max(0, round((maxx - minx) / cell)), max(0, round((maxy - miny) / cell))
    at = spark.range(rows * cols).select((F.col("id") / max(1, cols)).cast("long").alias("row"), (F.col("id") % max(1, cols)).alias("col"))
    return at.select("row", "col", (F.lit(maxy) - (F.col("row") + 0.5) * cell).alias("y"), (F.lit(minx) + (F.col("col") + 0.5) * cell).alias("x"))


def cell_index(df: DataFrame, x0: float, y0: float, cell: float) -> DataFrame:
    """df with integer row and col of its coordinates; joins go by these, never by equality of floating numbers."""
    return df.withColumns({"col": F.floor((F.col("x") - x0) / cell).cast("long"), "row": F.floor((y0 - F.col("y")) / cell).cast("long")})


def resample_nearest(fine: DataFrame, coarse: DataFrame, ratio: int, keys: list[str] | None = None) -> DataFrame:
    """Give each fine cell the values of the coarse cell that it lies in: an equi-join of integer cells (NULL outside)."""
    keys = keys or []
    up = coarse.withColumnsRenamed({"row": "__row", "col": "__col"})
    down = fine.withColumns({"__row": F.floor(F.col("row") / ratio).cast("long"), "__col": F.floor(F.col("col") / ratio).cast("long")})
    return down.join(up, [*keys, "__row", "__col"], "left").drop("__row", "__col")


def on_grid(grid: DataFrame, scene: DataFrame, keys: list[str]) -> DataFrame:
    """All cells of the grid with the scene's values, NULL where it has none."""
    return grid.join(scene, keys, "left")


def by_chunk(df: DataFrame, size: int = 1024) -> DataFrame:
    """Deal rows out by square chunks of cells, so that neighbours are written together."""
    return df.repartition(F.floor(F.col("row") / size), F.floor(F.col("col") / size))


def with_reference(df: DataFrame, epsg: int, *columns: str) -> DataFrame:
    """df with the number of its spatial reference in the metadata of the columns, where Parquet files keep it."""
    return df.withColumns({c: F.col(c).alias(c, metadata=df.schema[c].metadata | {"epsg": epsg}) for c in columns})


def reference(df: DataFrame, column: str) -> int | None:
    """The spatial reference that a column carries, if any."""
    return df.schema[column].metadata.get("epsg")
