"""Scene catalogues, rasters and results in files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafseason.operators.catalog import file_stem, parse_scene_id, time_in_name
from leafseason.schema import EMPTY_TEMPLATE, NODATA
from leafseason.sources import geotiff
from leafseason.workers import ship

ship(__name__)

ITEMS = "features array<struct<id: string, collection: string, assets: map<string, struct<href: string>>>>"


def read_catalogue(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scenes of item collections in JSON: one document a file, or with lines one a line."""
    items = spark.read.schema(ITEMS).option("multiLine", not lines).json(path).select(F.explode("features").alias("i"))
    return items.select(F.col("i.id").alias("scene_id"), parse_scene_id(F.col("i.id")).alias("scene_ts"), F.col("i.collection").alias("collection"), F.col("i.assets").alias("assets"))


def read_text_json(spark: SparkSession, path: str) -> DataFrame:
    """(json): each file as one text, for band descriptions and model files."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def explode_tiles(tiles: DataFrame, bands: list[str]) -> DataFrame:
    """Pixels of tiles stored as arrays: scene_id, row0, col0, width and one array of each band, row by row."""
    every = tiles.select("scene_id", "row0", "col0", "width", F.posexplode(F.arrays_zip(*bands)).alias("at", "v"))
    place = {"row": F.col("row0") + F.floor(F.col("at") / F.col("width")), "col": F.col("col0") + F.col("at") % F.col("width")}
    return every.withColumns(place).select("scene_id", "row", "col", *(F.when(~F.isnan(F.col("v")[b]), F.col("v")[b]).alias(b) for b in bands))


def read_geotiff(spark: SparkSession, path: str, bands: dict[str, int]) -> DataFrame:
    """(path, y, x and a column for each named band, counted from 1) of the GeoTIFF files that match path, nodata as NULL.

    A file is decoded strip by strip or tile by tile; see geotiff.py for the kinds of files that are understood.
    """
    schema = "path string, y double, x double, " + ", ".join(f"`{b}` float" for b in bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raster = geotiff.Raster(content.as_buffer())
                for top, left, block in raster.blocks():
                    _, h, w = block.shape
                    r, c = np.mgrid[top : top + h, left : left + w]
                    x, y = raster.centre(r.ravel(), c.ravel())
                    values = [block[k - 1].ravel().astype(np.float32) for k in bands.values()]
                    hidden = [np.isnan(v) if raster.nodata is None else np.isnan(v) | (v == np.float32(raster.nodata)) for v in values]
                    arrays = [pa.array([name] * len(y)), pa.array(y), pa.array(x), *(pa.array(v, mask=m) for v, m in zip(values, hidden, strict=True))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["path", "y", "x", *bands])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def geotiff_tiles(df: DataFrame, value: str, name: Column, origin: tuple[float, float], cell: float, size: int = 1024, nodata: float = NODATA, epsg: int | None = None) -> DataFrame:
    """(name, content): a GeoTIFF of each square of size x size cells that has rows of (row, col, value), one float band.

    NULL and absent cells are nodata. name tells results apart (see catalog.result_name); the square's numbers are added to
    it. A task holds one square at a time; of rows of one cell any may stand.
    """

    def draw(key: tuple, part: pa.Table) -> pa.Table:
        of, top, left = (k.as_py() for k in key)
        image = np.full((size, size), nodata, np.float32)
        value = part.column("__value").fill_null(nodata).to_numpy()
        image[part.column("row").to_numpy() - top * size, part.column("col").to_numpy() - left * size] = np.where(np.isnan(value), nodata, value)
        corner = origin[0] + left * size * cell, origin[1] - top * size * cell
        return pa.table({"name": [f"{of}_{top}_{left}.tif"], "content": [geotiff.encode(image[None], *corner, cell, nodata, epsg)]}, schema=pa.schema([("name", pa.string()), ("content", pa.binary())]))

    square = {"__name": name, "__top": F.floor(F.col("row") / size).cast("long"), "__left": F.floor(F.col("col") / size).cast("long"), "__value": F.col(value).cast("float")}
    rows = df.withColumns(square).select("__name", "__top", "__left", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "__value")
    return rows.groupBy("__name", "__top", "__left").applyInArrow(draw, "name string, content binary")


def export(named: DataFrame, folder: str) -> None:
    """Write the (name, content) rows as files into a folder that all executors reach; each is written aside and then moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        local = folder.removeprefix("file:")
        files, top = (fs.LocalFileSystem(), "/" + local.lstrip("/")) if local != folder or ":" not in folder else fs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                aside = f"{top}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(aside) as out:
                    out.write(content)
                files.move(aside, f"{top}/{name}")
            yield batch.select(["name"])

    named.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def write_template(grid: DataFrame, folder: str, name: str, origin: tuple[float, float], cell: float, value: str = "seed", epsg: int | None = None) -> None:
    """Store a (clipped) template as GeoTIFF squares; its empty cells get the template's own empty value."""
    export(geotiff_tiles(grid, value, F.lit(f"{name}_bbox_template"), origin, cell, nodata=EMPTY_TEMPLATE, epsg=epsg), folder)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Scores by day, with band 1 and the full time of each scene as key; days written again replace only themselves."""
    out = predictions.withColumns({"band": F.lit(1), "date": F.to_date("scene_ts")})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_predictions(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """All scores with the file that each comes from, ordered by scene; pattern: which files count, as in "part-*"."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    return reader.parquet(path).withColumn("file_name", F.col("_metadata.file_name")).orderBy("scene_ts")


def scan_results(spark: SparkSession, path: str, pattern: str = "Proba_*.tif", bands: dict[str, int] | None = None) -> DataFrame:
    """Pixels of the result rasters in a folder whose names fit the pattern, with scene_ts from the name, ordered by name."""
    pixels = read_geotiff(spark, f"{path}/{pattern}", bands or {"proba": 1})
    named = pixels.withColumn("name", file_stem(F.col("path")))
    return named.withColumn("scene_ts", time_in_name(F.regexp_replace("name", r"(_-?\d+_-?\d+)$", ""))).drop("path").orderBy("name")


def write_normalized(df: DataFrame, path: str, keys: list[str], indices: list[str]) -> None:
    """Normalised indices as rows (keys, vi, value), stored by index and day."""
    every = F.array(*(F.struct(F.lit(i).alias("vi"), F.col(i).alias("value")) for i in indices))
    rows = df.select(*keys, F.explode(every).alias("e")).select(*keys, "e.*").withColumn("date", F.to_date("scene_ts"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("vi", "date").parquet(path)


def read_normalized(spark: SparkSession, path: str) -> DataFrame:
    """What write_normalized stored."""
    return spark.read.parquet(path)
