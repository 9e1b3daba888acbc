import datetime as dt

import numpy as np
from leafseason.operators.score import Logistic
from leafseason.plans import pipeline
from leafseason.schema import FEATURES
from leafseason.sources import state
from leafseason.streaming import season_stream
from pyspark.sql import functions as F

MODEL = Logistic(dict.fromkeys(FEATURES.values(), 0.4), -0.5)
SCHEMA = "scene_ts timestamp, row long, col long, red double, green double, blue double, nir double, swir double, rededge double, terrain double, cloud double, forest int"


def pixels(spark, days):
    rng = np.random.default_rng(5)
    rows = []
    for d in range(1, days + 1):
        for k in range(6):
            rows.append((dt.datetime(2018, 6, d, 10), k // 3, k % 3, *map(float, rng.integers(1, 50, 6)), 10.0, float(rng.random() < 0.2), 1))
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    a, b = a.select(*(F.round(c, 9) if t == "double" else F.col(c) for c, t in a.dtypes)), b.select(*(F.round(c, 9) if t == "double" else F.col(c) for c, t in b.select(*a.columns).dtypes))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_batches_with_state_equal_one_season(spark, tmp_path):
    obs, folder = pixels(spark, 6), str(tmp_path / "state")
    scenes = obs.select("scene_ts").distinct()
    whole = pipeline.run_season(obs, scorer=MODEL)
    first = pipeline.run_batch(scenes.where("day(scene_ts) <= 3"), obs, folder, "2018-03-01", scorer=MODEL)
    second = pipeline.run_batch(scenes, obs, folder, "2018-03-01", scorer=MODEL)
    assert first.count() == 18 and second.count() == 18
    assert same(whole, first.unionByName(second))
    assert pipeline.run_batch(scenes, obs, folder, "2018-03-01", scorer=MODEL).isEmpty()
    meta = state.load_meta(spark, folder, 2018).first()
    assert meta.version == 2 and meta.processed_dates[0] == "2018-06-01T10:00:00" and len(meta.processed_dates) == 6
    one = pipeline.run_date(spark, scenes, obs, folder, "2018-06-04", MODEL)
    assert one.count() == 6
    assert pipeline.run_date(spark, scenes, obs, str(tmp_path / "none"), "2018-06-04", MODEL).isEmpty()


def test_in_memory_and_cold_start(spark):
    obs = pixels(spark, 3)
    scenes = obs.select("scene_ts").distinct()
    grid = obs.select("row", "col").distinct().withColumn("seed", F.lit(None).cast("double"))
    assert same(pipeline.run_batch(scenes, obs, None, "2018-03-01", scorer=MODEL, grid=grid), pipeline.run_season(obs, scorer=MODEL))
    assert pipeline.run_season(obs, emit="bounds").count() == 18
    assert pipeline.run_season(obs, emit="normalized", inf_policy="reset").count() == 18


def test_stream_folds_like_a_batch(spark, tmp_path):
    obs, source = pixels(spark, 5), str(tmp_path / "in")
    sent = []
    for days in ("day(scene_ts) <= 2", "day(scene_ts) > 2"):
        obs.where(days).write.mode("append").parquet(source)
        stream = season_stream.read_stream(spark, source, SCHEMA)
        season_stream.season_stream(stream, str(tmp_path / "s"), str(tmp_path / "c"), 2018, lambda b, n: sent.append(b.count())).awaitTermination()
    assert sum(sent) == 30
    want = pipeline.run_season(obs, emit="bounds").where("day(scene_ts) = 5").drop("scene_ts")
    assert same(want, state.load_bounds(spark, str(tmp_path / "s"), 2018))


def test_stateful_and_first_seen_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(k, dt.datetime(2020, 1, d), v) for d, k, v in [(1, 1, 5.0), (2, 1, 3.0), (3, 1, float("nan")), (4, 2, float("inf")), (5, 1, 9.0)]]
    df = spark.createDataFrame(rows, "k long, ts timestamp, v double")
    for part in ("day(ts) < 3", "day(ts) >= 3"):
        df.where(part).coalesce(1).write.mode("append").parquet(source)
        stream = season_stream.read_stream(spark, source, "k long, ts timestamp, v double")
        made = season_stream.running_by_state(stream, "k", "ts", "v")
        season_stream.drain(made, lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "c"), "append")
    got = {r.ts.day: (r.v_min, r.v_max) for r in spark.read.parquet(out).where("k = 1").collect()}
    assert got == {1: (5.0, 5.0), 2: (3.0, 5.0), 3: (3.0, 5.0), 5: (3.0, 9.0)}
    firsts = season_stream.first_seen(season_stream.read_stream(spark, source, "k long, ts timestamp, v double"), "k")
    season_stream.drain(firsts, lambda b, n: b.write.mode("append").parquet(out + "2"), str(tmp_path / "c2"), "append")
    assert spark.read.parquet(out + "2").select("k").distinct().count() == spark.read.parquet(out + "2").count() == 2
