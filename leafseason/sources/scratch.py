"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}  # paths by application


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where spark.checkpoint.dir is unset, a folder below the warehouse on a local master; elsewhere an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, remembered for release()."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession, keep: int = 0) -> int:
    """Delete the intermediate tables of this application but the first `keep`, once what was made of them is stored. Returns how many."""
    paths = _made.get(spark.sparkContext.applicationId, [])
    gone = paths[keep:]
    del paths[keep:]
    delete(spark, *gone)
    return len(gone)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is made inside, for results that are stored inside as well."""
    keep = len(_made.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, keep)


def write_table(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df as written once to the shared folder, and the path."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df once to the shared folder and read it back, so that a lost executor costs no recomputation."""
    return write_table(df, tag)[0]
