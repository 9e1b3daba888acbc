"""Seasonal bounds kept between runs.

A state folder holds parts of bounds, {folder}/bounds/year=Y/version=V, and one row of meta for each version, {folder}/meta.
A version consists of the parts from its base on: a run adds a part with the bounds of its own scenes, so it writes what it
has read and not the whole state, and reading takes the least and greatest over the parts. Every CHAIN parts are written
together as one, the base of what follows. A version counts only once its meta row is written, data before progress, so a run
that dies in between is repeated without harm; folders being read are never overwritten. All access goes through Spark, so
any file system does.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafseason.operators.catalog import iso
from leafseason.operators.season import final_bounds, merge_bounds
from leafseason.schema import STATE_META

CHAIN = 8


def load_meta(spark: SparkSession, folder: str | None, year: int | None = None) -> DataFrame:
    """(year, version, processed_dates, last_updated) of the newest version of each year; empty if there is no state."""
    empty = spark.createDataFrame([], STATE_META)
    if folder is None:
        return empty
    try:
        meta = spark.read.schema(STATE_META).json(f"{folder}/meta")
    except AnalysisException:
        return empty
    if year is not None:
        meta = meta.where(F.col("year") == year)
    return meta.groupBy("year").agg(F.max_by(F.struct(*meta.columns), "version").alias("m")).select("m.*")


def processed_dates(spark: SparkSession, folder: str | None, year: int | None = None) -> DataFrame:
    """(processed_date) of all scenes folded so far."""
    return load_meta(spark, folder, year).select(F.explode("processed_dates").alias("processed_date"))


def load_bounds(spark: SparkSession, folder: str | None, year: int) -> DataFrame | None:
    """The newest bounds of a year, one row a pixel, or None if there are none."""
    newest = load_meta(spark, folder, year).first()
    if newest is None:
        return None
    parts = range(newest["base"] or newest["version"], newest["version"] + 1)
    bounds = spark.read.parquet(*(f"{folder}/bounds/year={year}/version={v}" for v in parts))
    if len(parts) == 1:
        return bounds
    ends = {c: f for c in bounds.columns for end, f in (("_min", F.min), ("_max", F.max)) if c.endswith(end)}
    return bounds.groupBy(*(c for c in bounds.columns if c not in ends)).agg(*(f(c).alias(c) for c, f in ends.items()))


def save_bounds(bounds: DataFrame, folder: str, year: int, dates: list[str], partitions: int | None = None, part: bool = False) -> int:
    """Write a new version: bounds first, then its meta row with the sorted union of dates. Returns the version.

    part: bounds are added to those that are there; otherwise they stand for the whole year.
    """
    spark = bounds.sparkSession
    before = load_meta(spark, folder, year).first()
    version = (before["version"] if before else 0) + 1
    base = (before["base"] or before["version"]) if part and before else version
    union = sorted({*(before["processed_dates"] if before else []), *dates})
    (bounds.coalesce(partitions) if partitions else bounds).write.mode("overwrite").parquet(f"{folder}/bounds/year={year}/version={version}")
    row = [(year, version, union, datetime.now(UTC).isoformat(), base)]
    spark.createDataFrame(row, STATE_META).coalesce(1).write.mode("append").json(f"{folder}/meta")
    return version


def compact(spark: SparkSession, folder: str, year: int) -> None:
    """Write a year's bounds as one part."""
    bounds = load_bounds(spark, folder, year)
    if bounds is not None:
        save_bounds(bounds, folder, year, [])


def fold(vis: DataFrame, keys: list[str], folder: str, year: int, old: DataFrame | None) -> None:
    """Add the bounds of a batch of masked indices and mark its scenes; nothing is written without rows.

    old: the bounds before, which a first part takes in (as seeds).
    """
    dates = [r[0] for r in vis.select(iso(F.col("scene_ts"))).distinct().collect()]  # the scenes of one run
    if not dates:
        return
    spark, batch = vis.sparkSession, final_bounds(vis, keys)
    newest = load_meta(spark, folder, year).first()
    if newest is None:
        save_bounds(merge_bounds(old, batch, keys) if old is not None else batch, folder, year, dates)
        return
    save_bounds(batch, folder, year, dates, part=True)
    if newest["version"] + 2 - (newest["base"] or newest["version"]) > CHAIN:
        compact(spark, folder, year)


def prune(spark: SparkSession, folder: str, year: int) -> int:
    """Delete the parts below the newest version's base, once nothing reads them any more. Returns how many went."""
    newest = load_meta(spark, folder, year).first()
    gone = 0
    for version in range((newest["base"] or newest["version"]) - 1 if newest else 0, 0, -1):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bounds/year={year}/version={version}")
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(path):
            break
        gone += files.delete(path, True)
    return gone
