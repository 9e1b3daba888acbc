"""Whole analyses: a season in one query, a batch against kept state, a single date against kept bounds.

Observations are pixel rows with scene_ts, row, col, the six bands, terrain, cloud and forest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafseason.functions.indices import with_indices
from leafseason.operators.catalog import closest_scene, new_scenes, scenes_between, season, season_year
from leafseason.operators.grid import Box, clip
from leafseason.operators.mask import masked, with_valid
from leafseason.operators.score import Scorer, SparkModel, feature_frame, score
from leafseason.operators.season import final_bounds, normalized, running_bounds
from leafseason.schema import INDICES
from leafseason.sources import state
from leafseason.sources.files import write_normalized, write_predictions

PIXEL = ["row", "col"]
BOUNDS = [f"{i}_{e}" for i in INDICES for e in ("min", "max")]


def masked_indices(obs: DataFrame, forest: DataFrame | None = None, inf_policy: str = "ignore", single: bool = False) -> DataFrame:
    """The five indices of every pixel, NULL where it is not valid."""
    return masked(with_indices(with_valid(obs, forest, PIXEL), single=single, infinities=inf_policy == "reset"), INDICES)


def counted(vis: DataFrame, watch: Observation | None) -> DataFrame:
    """vis, whose pixels and valid pixels are counted on the way."""
    return vis if watch is None else vis.observe(watch, F.count("*").alias("n_pixels"), F.count_if("valid").alias("n_valid"))


def finished(df: DataFrame, keys: list[str], emit: str, scorer: Scorer | SparkModel | None) -> DataFrame:
    """Bounds, normalised indices or scores of rows that have their bounds."""
    if emit == "bounds":
        return df.select(*keys, *BOUNDS)
    scaled = normalized(df).select(*keys, *INDICES)
    if emit == "normalized":
        return scaled
    if emit != "scores" or scorer is None:
        raise ValueError("emit must be bounds, normalized or scores; scores need a scorer")
    return score(feature_frame(scaled, keys), scorer)


def prepared(obs: DataFrame, year: int | None = None, bbox: Box = None, grid: DataFrame | None = None, cell: float = 0.0) -> DataFrame:
    """Rows of a year, in a box (needs x and y) and on the cells of a grid (row, col); what isn't asked for isn't cut."""
    if year is not None:
        obs = obs.where(F.year("scene_ts") == year)
    obs = clip(obs, bbox, cell)
    return obs if grid is None else obs.join(grid.select(*PIXEL).distinct(), PIXEL, "left_semi")


def grid_seed(grid: DataFrame) -> DataFrame:
    """A grid's seed values as the bounds of a cold start."""
    return grid.select(*PIXEL, *(F.col("seed").cast("double").alias(b) for b in BOUNDS))


def write_result(result: DataFrame, sink: str | None, emit: str) -> None:
    """Store scores or normalised indices; bounds have their own state, and without a sink nothing is written."""
    if sink is not None and emit == "scores":
        write_predictions(result, sink)
    elif sink is not None and emit == "normalized":
        write_normalized(result, sink, ["scene_ts", *PIXEL], list(INDICES))


def run_season(
    obs: DataFrame,
    emit: str = "scores",
    scorer: Scorer | SparkModel | None = None,
    forest: DataFrame | None = None,
    seed: DataFrame | None = None,
    inf_policy: str = "ignore",
    bbox: Box = None,
    grid: DataFrame | None = None,
    sink: str | None = None,
    watch: Observation | None = None,
) -> DataFrame:
    """Each scene against the bounds of all scenes up to itself, by year: one window over the whole season.

    Of rows of one pixel and time the order is open, so there should be one. watch counts pixels and valid pixels once the
    result, or what is written to sink, has been computed.
    """
    vis = counted(masked_indices(prepared(obs, None, bbox, grid), forest, inf_policy), watch).withColumn("year", F.year("scene_ts"))
    bounds = running_bounds(vis, ["year", *PIXEL], ["scene_ts"], inf_policy=inf_policy, seed=seed)
    result = finished(bounds, ["scene_ts", *PIXEL], emit, scorer)
    write_result(result, sink, emit)
    return result


def run_batch(
    scenes: DataFrame,
    obs: DataFrame,
    folder: str | None,
    start: str,
    emit: str = "scores",
    scorer: Scorer | SparkModel | None = None,
    grid: DataFrame | None = None,
    forest: DataFrame | None = None,
    end: str | None = None,
    bbox: Box = None,
    sink: str | None = None,
    refold: bool = False,
) -> DataFrame:
    """Fold the scenes from start to end that the state has not seen and return their results; nothing new gives an empty result.

    The state is that of start's year. grid: the cells that take part, with seed values for a cold start. Without a folder
    nothing is kept. Scenes are marked as processed only if they have pixels, so that unusable ones are tried again. A scene
    is known by its time and expected whole; with refold the rows of known scenes are folded as well, for scenes that come in
    pieces. Folding rows again changes nothing.
    """
    spark, year = obs.sparkSession, season_year(start)
    first, last = season(year, start, end)
    asked = scenes_between(scenes, first, last)
    if not refold:
        asked = new_scenes(asked, state.processed_dates(spark, folder, year))
    rows = prepared(obs, year, bbox, grid).join(asked.select("scene_ts"), "scene_ts", "left_semi")
    seed = state.load_bounds(spark, folder, year)
    if seed is None and grid is not None:
        seed = grid_seed(grid)
    vis = masked_indices(rows, forest)
    result = finished(running_bounds(vis, PIXEL, ["scene_ts"], seed=seed), ["scene_ts", *PIXEL], emit, scorer)
    write_result(result, sink, emit)
    if folder is not None:
        state.fold(vis, PIXEL, folder, year, seed)
    return result


def run_date(
    spark: SparkSession,
    scenes: DataFrame,
    obs: DataFrame,
    folder: str,
    target: str,
    scorer: Scorer | SparkModel | None = None,
    forest: DataFrame | None = None,
    bbox: Box = None,
    sink: str | None = None,
    emit: str = "scores",
) -> DataFrame:
    """Results of the scene nearest to a date against the kept bounds of its year; empty without scene or bounds."""
    year = season_year(target)
    bounds = state.load_bounds(spark, folder, year)
    rows = prepared(obs, year, bbox).join(F.broadcast(closest_scene(scenes, target).select("scene_ts")), "scene_ts", "left_semi")  # at most one row
    vis = masked_indices(rows, forest)
    if bounds is None:
        bounds = final_bounds(vis.limit(0), PIXEL)
    result = finished(vis.join(bounds, PIXEL), ["scene_ts", *PIXEL], emit, scorer)
    write_result(result, sink, emit)
    return result
