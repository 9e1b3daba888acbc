import datetime as dt
import json

from leafseason.operators import catalog, grid, score, summary
from leafseason.schema import FEATURES, INDICES, SCENES
from leafseason.sources import files
from pyspark.sql import functions as F

T = dt.datetime


def scenes(spark, *ids):
    assets = {"a-bands-10m.tif": {"href": "u10"}, "a-bands-20m.tif": {"href": "u20"}, "a-masks-10m.tif": {"href": "um"}}
    rows = [(i, None, "c", assets) for i in ids]
    return spark.createDataFrame(rows, SCENES).withColumn("scene_ts", catalog.parse_scene_id(F.col("scene_id")))


def test_ranges_new_and_nearest(spark):
    s = scenes(spark, "2018-06-27t104021", "2018-06-25T104021", "2018-03-02t000000", "2018-07-01t235959", "junk")
    assert [r.scene_id for r in catalog.scenes_between(s, "2018-06-01", "2018-07-01").collect()] == ["2018-06-25T104021", "2018-06-27t104021", "2018-07-01t235959"]
    done = spark.createDataFrame([("2018-06-27T10:40:21",)], "processed_date string")
    assert "2018-06-27t104021" not in {r.scene_id for r in catalog.new_scenes(s, done).collect()}
    assert catalog.closest_scene(s, "2018-06-27").first().scene_id == "2018-06-27t104021"
    assert catalog.closest_scene(s, "2019-06-27").isEmpty()
    tie = scenes(spark, "2018-06-12t000000", "2018-06-10t000000")
    assert catalog.closest_scene(tie, "2018-06-11").first().scene_id == "2018-06-10t000000"
    assert catalog.season(2018) == ("2018-03-01", "2018-09-30")


def test_nearest_per_key(spark):
    s = spark.createDataFrame([("a", T(2020, 1, 1)), ("a", T(2020, 1, 5)), ("b", T(2020, 1, 9))], "k string, scene_ts timestamp")
    t = spark.createDataFrame([("a", T(2020, 1, 3)), ("a", T(2020, 1, 4)), ("b", T(2020, 1, 1)), ("c", T(2020, 1, 1))], "k string, target_ts timestamp")
    got = {(r.k, r.target_ts.day): r.nearest_ts and r.nearest_ts.day for r in catalog.closest_per_key(t, s, ["k"]).collect()}
    assert got == {("a", 3): 1, ("a", 4): 5, ("b", 1): 9, ("c", 1): None}


def test_assets_and_bands(spark, tmp_path):
    s = scenes(spark, "2018-06-27t104021")
    assert catalog.resolve_assets(s).select(*catalog.ASSETS, "usable").first() == ("u10", "u20", "um", True)
    less = s.withColumn("assets", F.map_filter("assets", lambda k, _: ~k.endswith("masks-10m.tif")))
    assert catalog.resolve_assets(less).select("masks_10m", "usable").first() == (None, False)
    said = spark.createDataFrame([(json.dumps({"BANDS-10M": {"BANDS": [{"id": "B4"}]}, "BANDS-20M": {"BANDS": [{"id": "B5"}]}}),)], "json string")
    assert {tuple(r) for r in catalog.band_ids(said).collect()} == {("BANDS-10M", "B4"), ("BANDS-20M", "B5")}
    (tmp_path / "items.json").write_text(json.dumps({"features": [{"id": "2018-06-27t104021", "collection": "c", "assets": {"x": {"href": "u"}}}]}))
    got = files.read_catalogue(spark, str(tmp_path)).first()
    assert got.scene_ts == T(2018, 6, 27, 10, 40, 21) and got.assets["x"].href == "u"


def test_grids(spark):
    cells = grid.generated_grid(spark, (0, 0, 40, 30), 10)
    assert cells.count() == 12
    assert grid.clip(cells, (0, 0, 10, 10), cell=10).count() == 4  # footprints that touch the box
    assert grid.clip(cells, None).count() == 12
    index = grid.cell_index(cells.drop("row", "col"), 0, 30, 10)
    assert index.exceptAll(cells.select(*index.columns)).isEmpty()
    coarse = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "row long, col long, swir double")
    got = {(r.row, r.col): r.swir for r in grid.resample_nearest(cells, coarse, 2).collect()}
    assert got[0, 1] == 1.0 and got[2, 3] == 2.0 and got[0, 2] is None
    t = spark.createDataFrame([(0.0, 0.0, 255.0), (0.0, 1.0, 7.0)], "y double, x double, seed double")
    assert {r.seed for r in grid.template_grid(t).collect()} == {None, 7.0}
    tiles = spark.createDataFrame([("s", 4, 2, 2, [1.0, float("nan"), 3.0])], "scene_id string, row0 int, col0 int, width int, red array<float>")
    assert {(r.row, r.col, r.red) for r in files.explode_tiles(tiles, ["red"]).collect()} == {(4, 2, 1.0), (4, 3, None), (5, 2, 3.0)}


def test_scores(spark, tmp_path):
    w = dict.fromkeys(FEATURES.values(), 0.5)
    f = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0, 1.0, 1.0), (3, -1.0, -1.0, -1.0, -1.0, -1.0)], "k int, " + ", ".join(f"{i} double" for i in INDICES))
    frame = score.feature_frame(f, ["k"])
    a, b = (score.score(frame, s).orderBy("k").toPandas().proba.tolist() for s in (score.Logistic(w, 0.0), score.ArrowModel(score.LogisticModel(w, 0.0))))
    assert abs(a[0] - b[0]) < 1e-12 and a[1] != a[1] and b[1] != b[1]
    assert [r.label for r in score.score(frame, score.Logistic(w, 0.0), "label").orderBy("k").collect()] == [1, -9999, 0]
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    train = frame.na.drop().withColumn("label", F.when(F.col("k") == 1, 1.0).otherwise(0.0))
    Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES.values()), outputCol="v"), LogisticRegression(featuresCol="v")]).fit(train).write().overwrite().save(str(tmp_path / "m"))
    got = {r.k: r.proba for r in score.score(frame, score.SparkModel(str(tmp_path / "m"))).collect()}
    assert got[1] > 0.9 and got[2] is None and got[3] < 0.1


def test_summaries(spark, tmp_path):
    rows = [(T(2020, 1, 1, k), p) for k in (1, 2) for p in ([0.1, 0.3, None] if k == 1 else [-9999.0, 0.5])]
    df = spark.createDataFrame(rows, "scene_ts timestamp, proba double")
    assert [r.n_pixels for r in summary.scored_scenes(df, min_pixels=2).collect()] == [2]
    assert {(r.n_pixels, r.max_proba) for r in summary.season_summary(df).collect()} == {(2, 0.3), (1, 0.5)}
    files.write_predictions(df, str(tmp_path / "p"))
    assert files.read_predictions(spark, str(tmp_path / "p")).count() == 5  # both scenes of the day are kept
