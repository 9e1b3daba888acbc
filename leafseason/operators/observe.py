"""Observations: the bands, masks and forest of scenes put together, pixel by pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafseason.operators.catalog import parse_scene_id, resolve_assets
from leafseason.operators.grid import Box, cell_index, clip
from leafseason.operators.mask import with_valid

KEYS = ["scene_id", "row", "col"]


def load_observations(
    bands_10m: DataFrame,
    bands_20m: DataFrame,
    masks_10m: DataFrame,
    forest: DataFrame | None = None,
    bbox: Box = None,
    scenes: DataFrame | None = None,
    cell: float = 10.0,
    ratio: int = 2,
    origin: tuple[float, float] = (0.0, 0.0),
) -> DataFrame:
    """(scene_id, scene_ts, row, col, y, x, six bands, terrain, cloud, forest, valid) of the pixels of all scenes.

    Pixels need their 10 m bands and masks; a 20 m cell is handed to the ratio x ratio pixels that lie in it, and pixels
    without one have NULL there. forest: (y, x, forest); without it all pixels count as forest. Pixels whose cell meets bbox
    are kept, so a scene outside gives none. scenes: only those with all assets are taken. Cells are numbered from origin,
    the upper left corner of a grid that both resolutions share.

    All tables are keyed by scene and pixel before they are joined, so each moves once.
    """
    if scenes is not None:
        usable = resolve_assets(scenes).where("usable").select("scene_id").distinct()
        bands_10m = bands_10m.join(usable, "scene_id", "left_semi")
    fine = cell_index(clip(bands_10m, bbox, cell), *origin, cell).select(*KEYS, "y", "x", "red", "green", "blue", "nir")
    masks = cell_index(clip(masks_10m, bbox, cell), *origin, cell).select(*KEYS, "terrain", "cloud")
    part = F.sequence(F.lit(0).cast("long"), F.lit(ratio - 1).cast("long"))
    coarse = cell_index(clip(bands_20m, bbox, cell * ratio), *origin, cell * ratio)
    coarse = coarse.withColumn("__r", F.explode(part)).withColumn("__c", F.explode(part))
    coarse = coarse.select("scene_id", (F.col("row") * ratio + F.col("__r")).alias("row"), (F.col("col") * ratio + F.col("__c")).alias("col"), "swir", "rededge")
    met = fine.join(masks, KEYS).join(coarse, KEYS, "left")
    if forest is None:
        made = with_valid(met.withColumn("forest", F.lit(1)))
    else:
        made = with_valid(met, cell_index(clip(forest, bbox, cell), *origin, cell))
    return made.withColumn("scene_ts", parse_scene_id(F.col("scene_id"))).select("scene_id", "scene_ts", "row", "col", "y", "x", "red", "green", "blue", "nir", "swir", "rededge", "terrain", "cloud", "forest", "valid")
