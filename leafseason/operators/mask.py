"""Which pixels are valid, and hiding the others."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A mask's code for cloud, and the largest terrain code that is kept.
CLOUDY, TERRAIN_MOST = 1, 63


def valid_pixel(cloud: Column, terrain: Column, red: Column, forest: Column) -> Column:
    """Missing cloud counts as clear; missing terrain, red or forest counts as not valid. Never NULL."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    return ~cloud.eqNullSafe(F.lit(CLOUDY)) & sure(terrain <= TERRAIN_MOST) & sure(red > 0) & sure(forest == 1)


def with_valid(obs: DataFrame, forest: DataFrame | None = None, keys: Iterable[str] = ("row", "col")) -> DataFrame:
    """obs with the column valid. forest: mask cells to join by keys; a cell that it lacks is not forest."""
    if forest is not None:
        obs = obs.drop("forest").join(forest.select(*keys, "forest"), [*keys], "left")
    return obs.withColumn("valid", valid_pixel(F.col("cloud"), F.col("terrain"), F.col("red"), F.col("forest")))


def masked(df: DataFrame, columns: Iterable[str], valid: str = "valid") -> DataFrame:
    """NULL in the columns where the row is not valid; rows stay."""
    return df.withColumns({c: F.when(F.col(valid), F.col(c)) for c in columns})
