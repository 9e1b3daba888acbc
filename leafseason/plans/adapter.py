"""The driver's tables read as a pixel time series: a part is a pixel, a shipping date an acquisition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["px", "ts", "k1", "k2", "k3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six bands and the four parts of the mask of each line item; cloud is NULL (nodata) for return flag A."""
    items = table(spark, sf_dir, "lineitem")
    # Sizes are on parts, few against line items; Catalyst picks the join by their measured size.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    met = items.join(parts, items.l_partkey == parts.p_partkey)
    tax = F.round(F.col("l_tax") * 100)
    return met.select(
        F.col("l_partkey").alias("px"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("k1"),
        F.col("l_linenumber").alias("k2"),
        F.col("l_suppkey").alias("k3"),
        F.col("l_quantity").alias("red"),
        (F.col("l_quantity") * 0.5 + tax).alias("green"),
        (tax + 1).alias("blue"),
        F.round(F.col("l_extendedprice") / 1000).alias("nir"),
        (F.col("p_size") * F.lit(1.0)).alias("swir"),
        F.abs(F.round(F.col("l_discount") * 100)).alias("rededge"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 0).alias("cloud"),
        (F.col("l_linenumber") * 10).alias("terrain"),
        F.when(F.col("p_size") % 5 != 0, 1).otherwise(0).alias("forest"),
    )


#: The same in SQL; the last column is the whole mask.
OBS = """obs as (select l_partkey as px, l_shipdate as ts, l_orderkey as k1, l_linenumber as k2, l_suppkey as k3,
 l_quantity as red, l_quantity * 0.5::double + round(l_tax * 100) as green, round(l_tax * 100) + 1 as blue, round(l_extendedprice / 1000) as nir,
 p_size * 1.0::double as swir, abs(round(l_discount * 100)) as rededge, case l_returnflag when 'R' then 1 when 'N' then 0 end as cloud,
 l_linenumber * 10 as terrain, case when p_size % 5 <> 0 then 1 else 0 end as forest,
 ((case l_returnflag when 'R' then 1 when 'N' then 0 end) is distinct from 1 and l_linenumber * 10 <= 63 and l_quantity > 0 and p_size % 5 <> 0) as valid
 from lineitem join part on l_partkey = p_partkey)"""
