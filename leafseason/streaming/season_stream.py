"""Scenes as they arrive: new ones are folded into kept bounds, batch by batch.

Rows are folded in order of arrival and without a bound on lateness; results sent out before are not revised. A batch that
is repeated after a failure does no harm, because folding a scene again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafseason.operators.grid import Box
from leafseason.operators.season import running_bounds
from leafseason.plans.pipeline import PIXEL, grid_seed, masked_indices, prepared
from leafseason.sources import state
from leafseason.workers import ship

ship(__name__)

#: Rows of a key that leave running_by_state at once.
FRAME_ROWS = 100_000


def season_stream(
    obs: DataFrame,
    folder: str,
    checkpoint: str,
    year: int,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    forest: DataFrame | None = None,
    grid: DataFrame | None = None,
    bbox: Box = None,
) -> StreamingQuery:
    """Fold a stream of observations into the bounds of a year in folder, all that is there now.

    Every row counts, so a scene may come in any number of files and batches; rows of other years, outside the box or off the
    grid are passed over. Rows that come twice change no bound. grid's seed values start a year without bounds. on_batch gets
    each batch with its running bounds and number; a batch that is repeated after a failure keeps its number.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        vis = masked_indices(prepared(batch, year, bbox, grid), forest)
        old = state.load_bounds(spark, folder, year)
        if old is None and grid is not None:
            old = grid_seed(grid)
        if on_batch is not None:
            on_batch(running_bounds(vis, PIXEL, ["scene_ts"], seed=old), number)
        state.fold(vis, PIXEL, folder, year, old)

    return obs.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def minmax_updates(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Streaming bounds of each key, for the update and complete modes; NaN and infinities take no part."""
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    return stream.groupBy(key).agg(F.min(v).alias("v_min"), F.max(v).alias("v_max"))


def drain(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Run a stream over what is there now and wait for its end."""
    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_seen(stream: DataFrame, *key: str) -> DataFrame:
    """The first row to arrive of each key (one column or several), as new scenes of a stream.

    Late rows are taken without bound and no key is sent twice, so every key stays in the state for good. Of a key's rows
    in one batch any may be the one; where that matters, its columns belong to the key.
    """
    return stream.dropDuplicates(list(key))


def running_by_state(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Running bounds kept in the state store, one state a key: rows of a key leave with the bounds up to themselves.

    For bounds that need not be queried between batches; season_stream keeps them in a table instead. A key's rows of one
    batch come in several frames that are in no order among each other; they are held together and sorted as one.
    """

    def fold(k, frames, held):
        low, high = (np.nan if x is None else x for x in (held.get if held.exists else (None, None)))
        frames = list(frames)
        frame = (pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]).sort_values(order, kind="stable")
        frames.clear()
        seen = frame[value].to_numpy("float64", na_value=np.nan)
        seen = np.where(np.isinf(seen), np.nan, seen)
        lows, highs = np.fmin.accumulate(np.append(low, seen))[1:], np.fmax.accumulate(np.append(high, seen))[1:]
        held.update(tuple(None if np.isnan(x[-1]) else float(x[-1]) for x in (lows, highs)))
        for a in range(0, len(frame), FRAME_ROWS):
            own = slice(a, a + FRAME_ROWS)
            yield pd.DataFrame({key: k[0], order: frame[order].iloc[own].to_numpy(), "v_min": lows[own], "v_max": highs[own]})

    kinds = dict(stream.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, v_min double, v_max double"
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(fold, out, "low double, high double", "append", "NoTimeout")


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
