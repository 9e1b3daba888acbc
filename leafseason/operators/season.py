"""Running and final seasonal bounds of each pixel.

ignore: bounds are the least and greatest finite values so far. reset: a value of -inf forgets the lower bound and +inf the
upper one, and neither takes part itself; the order of values then matters.

All indices of a row are folded together, so any number of them costs one exchange by pixel.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafseason.functions.arithmetic import INF, finite
from leafseason.schema import INDICES

POLICIES = ("ignore", "reset")


def _check(policy: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"inf_policy must be one of {POLICIES}")


def running_bounds(df: DataFrame, keys: list[str], order: list[str], indices: Iterable[str] = INDICES, inf_policy: str = "ignore", seed: DataFrame | None = None) -> DataFrame:
    """df with {index}_min and {index}_max over each pixel's rows up to and including the present one.

    seed: earlier bounds by keys, columns {index}_min and {index}_max; taken as a value before all others.
    """
    _check(inf_policy)
    indices = list(indices)
    past = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if seed is not None:
        names = {f"{i}_{e}": f"__{i}_{e}" for i in indices for e in ("min", "max")}
        df = df.join(seed.select(*keys, *names).withColumnsRenamed(names), keys, "left")
    known = lambda i, e: F.col(f"__{i}_{e}") if seed is not None else F.lit(None).cast("double")
    if inf_policy == "ignore":
        out = df.withColumns({f"{i}_{e}": f(finite(F.col(i))).over(past) for i in indices for e, f in (("min", F.min), ("max", F.max))})
        if seed is not None:
            out = out.withColumns({f"{i}_{e}": f(F.col(f"{i}_{e}"), known(i, e)) for i in indices for e, f in (("min", F.least), ("max", F.greatest))})
    else:
        # How often a bound was forgotten so far; the largest (times forgotten, value) is then the bound, in the same window.
        ends = {"min": (-INF, -1), "max": (INF, 1)}
        times = {f"__n_{i}_{e}": F.count(F.when(F.col(i) == at, 1)).over(past) for i in indices for e, (at, _) in ends.items()}
        out = df.withColumns(times)
        best = {
            f"__b_{i}_{e}": F.max(F.struct(F.col(f"__n_{i}_{e}").alias("n"), (finite(F.col(i)) * sign).alias("v"))).over(past)
            for i in indices
            for e, (_, sign) in ends.items()
        }
        out = out.withColumns(best)
        made: dict[str, Column] = {}
        for i in indices:
            for e, (_, sign) in ends.items():
                here = F.col(f"__b_{i}_{e}")["v"] * sign
                join = F.least if e == "min" else F.greatest
                made[f"{i}_{e}"] = F.when(F.col(f"__n_{i}_{e}") == 0, join(here, known(i, e))).otherwise(here) if seed is not None else here
        out = out.withColumns(made)
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def final_bounds(df: DataFrame, keys: list[str], indices: Iterable[str] = INDICES, inf_policy: str = "ignore", order: list[str] | None = None, flags: bool = False) -> DataFrame:
    """One row a pixel: {index}_min and {index}_max over all its rows, aggregated before the exchange.

    reset needs order; it keeps the values after the last infinity of either sign. flags adds {index}_min_reset and
    {index}_max_reset, whether that bound was forgotten, which merge_bounds needs to join a batch to earlier bounds.
    """
    _check(inf_policy)
    indices = list(indices)
    if inf_policy == "ignore":
        made = [f(finite(F.col(i))).alias(f"{i}_{e}") for i in indices for e, f in (("min", F.min), ("max", F.max))]
        made += [F.lit(False).alias(f"{i}_{e}_reset") for i in indices for e in ("min", "max")] if flags else []
        return df.groupBy(*keys).agg(*made)
    if not order:
        raise ValueError("inf_policy reset needs an order")
    # The last row's running bounds: the window's exchange by pixel serves the aggregate as well, and the source is read once.
    at = F.struct(*order)
    made = [F.max_by(f"{i}_{e}", at).alias(f"{i}_{e}") for i in indices for e in ("min", "max")]
    if flags:
        made += [F.coalesce(F.bool_or(F.col(i) == v), F.lit(False)).alias(f"{i}_{e}_reset") for i in indices for e, v in (("min", -INF), ("max", INF))]
    return running_bounds(df, keys, order, indices, "reset").groupBy(*keys).agg(*made)


def merge_bounds(old: DataFrame, new: DataFrame, keys: list[str], indices: Iterable[str] = INDICES) -> DataFrame:
    """Earlier bounds joined with those of a later batch; where the batch says {index}_min_reset (max alike), its own bound stands."""
    indices = list(indices)
    a, b = old.alias("a"), new.alias("b")
    cond = F.lit(True)
    for k in keys:
        cond &= F.col(f"a.{k}") == F.col(f"b.{k}")
    made = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
    for i in indices:
        for e, f in (("min", F.least), ("max", F.greatest)):
            name = f"{i}_{e}"
            both = f(F.col(f"a.{name}"), F.col(f"b.{name}"))
            made.append((F.when(F.coalesce(F.col(f"b.{name}_reset"), F.lit(False)), F.col(f"b.{name}")).otherwise(both) if f"{name}_reset" in new.columns else both).alias(name))
    return a.join(b, cond, "full").select(*made)


def long_bounds(bounds: DataFrame, keys: list[str], indices: Iterable[str] = INDICES) -> DataFrame:
    """Wide bounds as rows (keys, vi, vi_min, vi_max)."""
    every = F.array(*(F.struct(F.lit(i).alias("vi"), F.col(f"{i}_min").alias("vi_min"), F.col(f"{i}_max").alias("vi_max")) for i in indices))
    return bounds.select(*keys, F.explode(every).alias("b")).select(*keys, "b.*")


def normalized(df: DataFrame, indices: Iterable[str] = INDICES, suffix: str = "") -> DataFrame:
    """Each index scaled by the row's bounds: 0 at min, 1 at max, not cut off outside; NULL if the bounds are equal."""
    return df.withColumns({f"{i}{suffix}": F.try_divide((F.col(i) - F.col(f"{i}_min")).cast("double"), (F.col(f"{i}_max") - F.col(f"{i}_min")).cast("double")) for i in indices})
