"""Masks and seasonal bounds against sequential folds."""

import numpy as np
import pytest
from leafseason.operators import mask, season
from pyspark.sql import functions as F

INF = float("inf")


def fold(values, reset):
    lo = hi = np.nan
    out = []
    with np.errstate(all="ignore"):
        for v in values:
            v = np.nan if v is None else v
            if not reset and not np.isfinite(v):
                v = np.nan
            lo, hi = np.fmin(lo, v), np.fmax(hi, v)
            lo, hi = (x if np.isfinite(x) else np.nan for x in (lo, hi))
            out.append((lo, hi))
    return np.array(out)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    pool = [None, INF, -INF, 1.0, 2.0, 3.0, -1.0]
    rows = [(p, t, pool[rng.integers(len(pool))]) for p in range(60) for t in range(20)]
    return rows, spark.createDataFrame(rows, "px int, t int, v double").repartition(3)


@pytest.mark.parametrize("policy", season.POLICIES)
def test_running_and_final_bounds(series, policy):
    rows, df = series
    got = season.running_bounds(df, ["px"], ["t"], ["v"], policy).orderBy("px", "t").select("v_min", "v_max").toPandas().to_numpy(float)
    want = np.concatenate([fold([v for p, _, v in rows if p == k], policy == "reset") for k in range(60)])
    assert np.array_equal(got, want, equal_nan=True)
    last = season.final_bounds(df, ["px"], ["v"], policy, ["t"]).orderBy("px").select("v_min", "v_max").toPandas().to_numpy(float)
    assert np.array_equal(last, want[19::20], equal_nan=True)


@pytest.mark.parametrize("policy", season.POLICIES)
def test_two_batches_equal_one_pass(series, policy):
    _, df = series
    one = season.final_bounds(df, ["px"], ["v"], policy, ["t"])
    early, late = (season.final_bounds(df.where(c), ["px"], ["v"], policy, ["t"], flags=True) for c in ("t < 9", "t >= 9"))
    two = season.merge_bounds(early.drop("v_min_reset", "v_max_reset"), late, ["px"], ["v"])
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    seeded = season.running_bounds(df.where("t >= 9"), ["px"], ["t"], ["v"], policy, seed=early).where("t = 19").select("px", "v_min", "v_max")
    assert one.exceptAll(seeded).isEmpty()


def test_folding_again_changes_nothing(series):
    _, df = series
    one = season.final_bounds(df, ["px"], ["v"])
    again = season.merge_bounds(one, one, ["px"], ["v"])
    assert one.exceptAll(again).isEmpty()


def test_cumulative_values_lie_between_zero_and_one(series):
    _, df = series
    rows = season.running_bounds(df.withColumn("v", F.when(F.abs("v") != INF, F.col("v"))), ["px"], ["t"], ["v"])
    got = season.normalized(rows, ["v"], "_n").agg(F.min("v_n"), F.max("v_n")).first()
    assert (got[0], got[1]) == (0.0, 1.0)


def test_valid_pixels(spark):
    rows = [(None, 1, 5, 1, True), (1, 1, 5, 1, False), (0, None, 5, 1, False), (0, 63, 5, 1, True), (0, 64, 5, 1, False), (0, 1, None, 1, False), (0, 1, 0, 1, False), (0, 1, 5, 0, False), (0, 1, 5, None, False)]
    df = spark.createDataFrame(rows, "cloud int, terrain int, red int, forest int, want boolean")
    assert mask.with_valid(df).where("valid != want or valid is null").isEmpty()
    assert [r.red for r in mask.masked(mask.with_valid(df), ["red"]).collect()] == [5, None, None, 5, None, None, None, None, None]


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        season.final_bounds(spark.range(1), ["id"], [], "other")
