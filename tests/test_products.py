"""Observations, runs with state, streams and sinks, by hand on small tables."""

import datetime as dt

import numpy as np
import pytest
from leafseason.operators import catalog, grid, observe, score, summary
from leafseason.plans import pipeline
from leafseason.schema import FEATURES, INDICES, SCENES
from leafseason.sources import files, state
from leafseason.streaming import season_stream
from pyspark.sql import Observation
from pyspark.sql import functions as F

T = dt.datetime
SCHEMA = "scene_ts timestamp, row long, col long, red double, green double, blue double, nir double, swir double, rededge double, terrain double, cloud double, forest int"
MODEL = score.Logistic(dict.fromkeys(FEATURES.values(), 0.4), -0.5)


def pixels(spark, times, seed=5):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(t, k // 3, k % 3, *map(float, rng.integers(1, 50, 6)), 10.0, 0.0, 1) for t in times for k in range(6)], SCHEMA)


def same(a, b):
    a, b = (x.select(*(F.round(c, 9) if t == "double" else F.col(c) for c, t in x.select(*a.columns).dtypes)) for x in (a, b))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_a_scene_in_two_files_keeps_all_pixels(spark, tmp_path):
    obs, source, folder = pixels(spark, [T(2018, 6, 1), T(2018, 6, 2), T(2019, 6, 1)]), str(tmp_path / "in"), str(tmp_path / "s")
    for part in ("col = 0", "col > 0"):
        obs.where(part).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second run has nothing to read
        stream = season_stream.read_stream(spark, source, SCHEMA, files_per_batch=1)
        season_stream.season_stream(stream, folder, str(tmp_path / "c"), 2018).awaitTermination()
    got = state.load_bounds(spark, folder, 2018)
    want = pipeline.final_bounds(pipeline.masked_indices(obs.where("year(scene_ts) = 2018")), pipeline.PIXEL)
    assert got.count() == 6 and same(got, want)
    assert state.load_bounds(spark, folder, 2019) is None
    assert state.load_meta(spark, folder, 2018).first().version == 2
    assert state.prune(spark, folder, 2018) == 0
    state.compact(spark, folder, 2018)
    assert state.load_meta(spark, folder, 2018).first().version == 3
    assert state.prune(spark, folder, 2018) == 2 and same(state.load_bounds(spark, folder, 2018), want)


def test_parts_are_joined_in_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "CHAIN", 3)
    obs, folder = pixels(spark, [T(2018, 6, d) for d in range(1, 6)]), str(tmp_path / "s")
    scenes, read = obs.select("scene_ts").distinct(), []
    for d in range(1, 6):
        pipeline.run_batch(scenes, obs, folder, "2018-06-01", "bounds", end=f"2018-06-0{d}")
        meta = state.load_meta(spark, folder, 2018).first()
        read.append((meta.version, meta.base, len(meta.processed_dates)))
    assert read == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (5, 5, 4), (6, 5, 5)]
    assert same(state.load_bounds(spark, folder, 2018), pipeline.final_bounds(pipeline.masked_indices(obs), pipeline.PIXEL))


def test_batches_take_pieces_boxes_grids_and_sinks(spark, tmp_path):
    obs, folder, sink = pixels(spark, [T(2018, 6, 1), T(2018, 7, 1)]), str(tmp_path / "s"), str(tmp_path / "out")
    scenes = obs.select("scene_ts").distinct()
    pipeline.run_batch(scenes, obs.where("col < 2"), folder, "2018-03-01", "bounds")
    assert pipeline.run_batch(scenes, obs, folder, "2018-03-01", "bounds").isEmpty()
    pipeline.run_batch(scenes, obs, folder, "2018-03-01", "bounds", refold=True)
    assert same(state.load_bounds(spark, folder, 2018), pipeline.final_bounds(pipeline.masked_indices(obs), pipeline.PIXEL))
    placed = obs.withColumns({"x": F.col("col") * 10.0, "y": F.col("row") * 10.0})
    assert pipeline.run_batch(scenes, placed, None, "2018-03-01", "bounds", bbox=(0.0, 0.0, 10.0, 0.0)).count() == 4
    cells = spark.createDataFrame([(0, 0, None), (1, 2, 0.25), (9, 9, None)], "row long, col long, seed double")
    got = pipeline.run_batch(scenes, obs, None, "2018-03-01", "bounds", grid=cells)
    assert got.count() == 4 and got.where("row = 1").agg(F.max("NDVI_min")).first()[0] <= 0.25
    assert pipeline.run_batch(scenes, obs, None, "2018-03-01", "bounds", end="2018-06-30").count() == 6
    kept = pipeline.run_batch(scenes, obs, None, "2018-03-01", scorer=MODEL, sink=sink)
    assert same(files.read_predictions(spark, sink).select(*kept.select("scene_ts", "row", "col", "proba").columns), kept.select("scene_ts", "row", "col", "proba"))
    pipeline.run_season(obs, "normalized", sink=sink + "2")
    assert files.read_normalized(spark, sink + "2").count() == 12 * len(INDICES)
    assert pipeline.run_date(spark, scenes, obs, folder, "2018-06-03", emit="normalized").count() == 6
    watch = Observation("season")
    pipeline.run_season(obs.withColumn("cloud", F.when(F.col("col") == 0, 1.0)), "bounds", watch=watch).collect()
    assert watch.get == {"n_pixels": 12, "n_valid": 8}


def test_observations_by_hand(spark):
    a, b = "2018-06-27t104021", "2018-06-28t104021"
    ten = spark.createDataFrame([(s, y, x, 5.0, 1.0, 1.0, 9.0) for s in (a, b) for y in (35.0, 25.0) for x in (5.0, 15.0, 25.0)], "scene_id string, y double, x double, red float, green float, blue float, nir float")
    twenty = spark.createDataFrame([(a, 30.0, 10.0, 7.0, None)], "scene_id string, y double, x double, swir float, rededge float")
    masks = spark.createDataFrame([(a, y, x, 10.0, None if x < 10 else 1.0) for y in (35.0, 25.0) for x in (5.0, 15.0, 25.0)], "scene_id string, y double, x double, terrain float, cloud float")
    forest = spark.createDataFrame([(35.0, 5.0, 1), (25.0, 5.0, 0)], "y double, x double, forest int")
    got = {(r.row, r.col): r for r in observe.load_observations(ten, twenty, masks, forest, origin=(0.0, 40.0)).collect()}
    assert sorted(got) == [(r, c) for r in (0, 1) for c in (0, 1, 2)]
    assert [got[0, c].swir for c in (0, 1, 2)] == [7.0, 7.0, None] and got[0, 0].scene_ts == T(2018, 6, 27, 10, 40, 21)
    assert [k for k, r in got.items() if r.valid] == [(0, 0)]
    boxed = observe.load_observations(ten, twenty, masks, bbox=(0.0, 30.0, 10.0, 40.0), origin=(0.0, 40.0)).collect()
    assert {(r.row, r.col) for r in boxed} == {(0, 0), (0, 1), (1, 0), (1, 1)}  # cells that meet the box
    assets = {"a-bands-10m.tif": {"href": "u"}, "a-bands-20m.tif": {"href": "u"}, "a-masks-10m.tif": {"href": "u"}}
    scenes = spark.createDataFrame([(a, T(2018, 6, 27), "c", assets), (b, None, "c", {}), ("z", T(2018, 1, 1), "c", {"a-bands-10m.tif": {"href": "u"}}), ("y", T(2018, 1, 2), "c", assets)], SCENES)
    assert observe.load_observations(ten, twenty, masks, scenes=scenes.where("scene_id = 'z'")).isEmpty()
    seen = spark.createDataFrame([(T(2018, 6, 27),)], "scene_ts timestamp")
    assert {r.scene_id: r.reason for r in catalog.unusable_scenes(scenes, seen).collect()} == {b: "no time in the id", "z": "lacks bands_20m, masks_10m", "y": "no pixels"}
    more = catalog.with_asset(scenes, "a-bands-10m.tif", "new").where("scene_id = 'z'").first()
    assert {k: v.href for k, v in more.assets.items()} == {"a-bands-10m.tif": "new"}


@pytest.mark.parametrize("days", [1, 3, 400])
def test_nearest_per_key_by_brute_force(spark, days):
    rng = np.random.default_rng(days)
    at = lambda n: [T(2020, 1, 1) + dt.timedelta(hours=int(h)) for h in rng.integers(0, 2000, n)]
    asked = [(k, t) for k in ("a", "b", None) for t in at(40)] + [("none", T(2020, 1, 1)), ("a", None)]
    there = [(k, t) for k in ("a", "a", "b", None) for t in at(15)] + [("a", None)]
    got = catalog.closest_per_key(spark.createDataFrame(asked, "k string, target_ts timestamp"), spark.createDataFrame(there, "k string, scene_ts timestamp"), ["k"], days=days).collect()
    want = [(k, t, min((s for j, s in there if j == k and s), key=lambda s: (abs(s - t), s), default=None) if t else None) for k, t in asked]
    assert sorted(map(str, ((r.k, r.target_ts, r.nearest_ts) for r in got))) == sorted(map(str, want))


def test_models_and_small_operators(spark, tmp_path):
    assert score.Logistic.from_json('{"weights": {"a": 2.0}, "intercept": 1.0}') == score.Logistic({"a": 2.0}, 1.0)
    cells = grid.generated_grid(spark, (0, 0, 80, 80), 10)
    near = grid.by_chunk(cells, 4).withColumn("p", F.spark_partition_id()).groupBy(F.floor(F.col("row") / 4), F.floor(F.col("col") / 4)).agg(F.count_distinct("p").alias("n"))
    assert [r.n for r in near.collect()] == [1] * 4
    grid.with_reference(cells, 2056, "x", "y").write.parquet(str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert grid.reference(back, "x") == 2056 and grid.reference(back, "row") is None
    names = spark.createDataFrame([("a/b/NDVI_2018-06-27t104021.tif",), ("odd",)], "f string").select(catalog.file_stem(F.col("f")).alias("s"))
    assert [tuple(r) for r in names.select("s", catalog.time_in_name(F.col("s"))).collect()] == [("NDVI_2018-06-27t104021", T(2018, 6, 27, 10, 40, 21)), ("odd", None)]


def test_drawings(spark, tmp_path):
    rows = [(T(2020, 1, d), r, c, None if r == c else 0.5) for d in (1, 2, 3, 4) for r in range(30) for c in range(20)]
    df = spark.createDataFrame(rows, "scene_ts timestamp, row long, col long, proba double")
    assert not summary.draw(df, T(2020, 1, 1), min_pixels=10_000) and not summary.draw(df, T(1999, 1, 1))
    path = tmp_path / "one.png"
    assert summary.draw(df, T(2020, 1, 1), str(path))
    image = summary.pictures(df.where("day(scene_ts) = 1"))[T(2020, 1, 1)]
    assert image.shape == (30, 20) and np.isnan(image).sum() == 20
    assert path.read_bytes()[:8] == b"\x89PNG\r\n\x1a\n" and int.from_bytes(path.read_bytes()[16:20], "big") == 20
    assert {i.shape for i in summary.pictures(df, most=150).values()} == {(15, 10)}
    assert summary.draw_grid(df, str(tmp_path / "all.png"), cols=3) == 4
    assert int.from_bytes((tmp_path / "all.png").read_bytes()[20:24], "big") == 2 * 34 + 12
    assert summary.pictures(df.limit(0)) == {}
