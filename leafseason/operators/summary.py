"""Summaries of scored scenes, and the drawings made of them."""

from __future__ import annotations

import math
import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafseason.schema import NODATA


def scored_scenes(predictions: DataFrame, scene: str = "scene_ts", min_pixels: int = 100) -> DataFrame:
    """(scene, n_pixels) of scenes with at least min_pixels scored pixels; unknown ones and NODATA don't count."""
    return predictions.groupBy(scene).agg(F.count(F.nullif("proba", F.lit(NODATA))).alias("n_pixels")).where(F.col("n_pixels") >= min_pixels)


def season_summary(predictions: DataFrame, scene: str = "scene_ts") -> DataFrame:
    """Number, mean, least and greatest probability of each scene's scored pixels."""
    p = F.nullif("proba", F.lit(NODATA))
    return predictions.groupBy(scene).agg(F.count(p).alias("n_pixels"), F.avg(p).alias("mean_proba"), F.min(p).alias("min_proba"), F.max(p).alias("max_proba"))


def pictures(predictions: DataFrame, most: int = 1_000_000) -> dict:
    """scene_ts to an image of its probabilities (row, col, proba), in order of time, all of one extent.

    Cells are averaged on the executors into at most `most` points a scene, so what comes to the driver is bounded.
    """
    known = predictions.select("scene_ts", "row", "col", F.nullif("proba", F.lit(NODATA)).alias("p")).where("p is not null")
    ends = known.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if ends[0] is None:
        return {}
    top, height, left, width = ends[0], ends[1] - ends[0] + 1, ends[2], ends[3] - ends[2] + 1
    step = max(1, math.ceil(math.sqrt(height * width / most)))
    place = (F.floor((F.col(c) - at) / step).cast("int").alias(n) for c, at, n in (("row", top, "r"), ("col", left, "c")))
    out = {}
    for scene, points in known.groupBy("scene_ts", *place).agg(F.avg("p").alias("p")).toPandas().groupby("scene_ts"):
        out[scene] = image = np.full((-(-height // step), -(-width // step)), np.nan)
        image[points.r, points.c] = points.p
    return out


def coloured(image: np.ndarray) -> np.ndarray:
    """Probabilities, cut to 0..1, from green over yellow to brown; white where unknown."""
    at = np.clip(np.nan_to_num(image), 0, 1)[..., None]
    green, yellow, brown = np.array([26, 120, 55]), np.array([250, 225, 120]), np.array([120, 60, 10])
    out = np.where(at < 0.5, green + (yellow - green) * at * 2, yellow + (brown - yellow) * (at * 2 - 1))
    out[np.isnan(image)] = 255
    return out.astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """A PNG file of (row, column, red green blue) bytes."""
    height, width, _ = image.shape
    lines = np.concatenate((np.zeros((height, 1), np.uint8), image.reshape(height, -1)), axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def draw(predictions: DataFrame, scene, path: str | None = None, min_pixels: int = 100, most: int = 1_000_000) -> bool:
    """Draw one scene's probabilities into a PNG file on the driver (no path: none); False if it has too few pixels."""
    own = predictions.where(F.col("scene_ts") == scene)
    if own.agg(F.count(F.nullif("proba", F.lit(NODATA)))).first()[0] < min_pixels:
        return False
    if path is not None:
        Path(path).write_bytes(png(coloured(next(iter(pictures(own, most).values()), np.full((1, 1), np.nan)))))
    return True


def draw_grid(predictions: DataFrame, path: str, cols: int = 3, most: int = 200_000, gap: int = 4) -> int:
    """Draw all scenes, in order of time, into one PNG file with `cols` a row and a scale from 0 to 1 below. Returns their number."""
    images = list(pictures(predictions, most).values())
    height, width = (max((i.shape[k] for i in images), default=1) for k in (0, 1))
    rows = math.ceil(len(images) / cols)
    sheet = np.full((rows * (height + gap) + 12, cols * (width + gap)), np.nan)
    for k, image in enumerate(images):
        top, left = k // cols * (height + gap), k % cols * (width + gap)
        sheet[top : top + image.shape[0], left : left + image.shape[1]] = image
    sheet[-8:] = np.linspace(0, 1, sheet.shape[1])
    Path(path).write_bytes(png(coloured(sheet)))
    return len(images)
