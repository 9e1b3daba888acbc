"""Queries of whole analyses: observations, seasons, batches with state, streams, sinks; with the SQL that says the same."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafseason.functions.indices import with_indices
from leafseason.operators import catalog, grid, observe
from leafseason.operators.score import Logistic
from leafseason.plans import pipeline
from leafseason.plans.adapter import KEYS, OBS, observations, table
from leafseason.plans.queries import COMPLETE, INTERCEPT, ORACLE_SQL, PLAIN, QUERIES, SQL_KEYS, WEIGHTS, Z, query, scenes
from leafseason.schema import INDICES
from leafseason.sources import files, state
from leafseason.sources.scratch import scratch
from leafseason.streaming import season_stream

__all__ = ["ORACLE_SQL", "QUERIES"]

YEAR = 1996
SCENE = "strftime(scene_ts, '%Y-%m-%d') as scene"
#: One observation of a pixel and month.
MONTHLY = f"""{OBS}, monthly as (select date_trunc('month', ts) as scene_ts, (px // 50)::bigint as row, (px % 50)::bigint as col, max(red) as red, max(green) as green, max(blue) as blue,
 max(nir) as nir, max(swir) as swir, max(rededge) as rededge, min(terrain) as terrain, max(cloud) as cloud, max(forest) as forest from obs group by all)"""
VALID = "(cloud is distinct from 1 and terrain <= 63 and red > 0 and forest = 1)"
VIS = f"{MONTHLY}, vis as (select scene_ts, year(scene_ts) as y, row, col, " + ", ".join(f'case when {VALID} then {v} end as "{k}"' for k, v in PLAIN.items()) + " from monthly)"
PAST = "over (partition by y, row, col order by scene_ts rows unbounded preceding)"
SCALED = f"{VIS}, bounds as (select *, " + ", ".join(f'{e}("{i}") {PAST} as "{i}_{e}"' for i in INDICES for e in ("min", "max")) + " from vis), scaled as (select scene_ts, y, row, col, " + ", ".join(f'("{i}" - "{i}_min") / nullif("{i}_max" - "{i}_min", 0) as "{i}"' for i in INDICES) + " from bounds)"
PROBA = f"case when {COMPLETE} then round(1 / (1 + exp(-({Z}))), 6) end as p"
MODEL = Logistic(WEIGHTS, INTERCEPT)
OF_YEAR = f'{VIS}, kept as (select row, col, {", ".join(f"{e}({chr(34)}{i}{chr(34)}) as {chr(34)}{i}_{e}{chr(34)}" for i in INDICES for e in ("min", "max"))} from vis where y = {YEAR} group by all)'


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    place = (F.floor(F.col("px") / 50).cast("long").alias("row"), (F.col("px") % 50).alias("col"))
    most = (F.max(c).alias(c) for c in ("red", "green", "blue", "nir", "swir", "rededge", "cloud", "forest"))
    return obs.groupBy(F.date_trunc("month", "ts").alias("scene_ts"), *place).agg(*most, F.min("terrain").alias("terrain"))


def shown(df: DataFrame) -> DataFrame:
    """Scores with the scene's day as text."""
    return df.select(F.date_format("scene_ts", "yyyy-MM-dd").alias("scene"), "row", "col", F.round("proba", 6).alias("p"))


_SINGLE = {k: f"{k}::float" for k in ("red", "green", "blue", "nir", "swir", "rededge")}
_OVER = lambda a, b: f"(({a} - {b}) / nullif({a} + {b}, 0::float))::double"


@query(
    f"with {OBS}, s as (select {SQL_KEYS}, " + ", ".join(f"{v} as {k}" for k, v in _SINGLE.items()) + f" from obs) select {SQL_KEYS}, {_OVER('nir', 'red')} as ndvi, {_OVER('nir', 'swir')} as ndmi, {_OVER('green', 'red')} as cci, "
    "(nir / nullif(rededge, 0::float) - 1::float)::double as cire, "
    "case when nir = red and (((nir + 6::float * red) - 7.5::float * blue) + 1::float) <> 0 then 0 else (2.5::float * ((nir - red) / nullif(((nir + 6::float * red) - 7.5::float * blue) + 1::float, 0::float)))::double end as evi from s"
)
def vi_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_indices(observations(spark, sf_dir), single=True)
    return made.select(*KEYS, *(F.col(i).cast("double").alias(i.lower()) for i in INDICES))


@query(
    f"with {MONTHLY}, m as (select strftime(scene_ts, '%Y-%m-%dt%H%M%S') as scene_id, month(scene_ts) as mon, row * 50 + col as px, * from monthly), "
    "c as (select scene_id, row // 2 as r, col // 2 as c, max(swir) as swir, max(rededge) as rededge from m where (row // 2 + col // 2) % 3 <> 0 group by all), "
    "f as (select p_partkey as px, case when p_size % 5 <> 0 then 1 else 0 end as forest from part where p_partkey % 7 <> 0) "
    "select m.scene_id, row, col, red, green, blue, nir, c.swir, c.rededge, terrain, cloud, f.forest, "
    "cloud is distinct from 1 and terrain <= 63 and red > 0 and coalesce(f.forest = 1, false) as valid from m left join c on c.scene_id = m.scene_id and r = row // 2 and c.c = col // 2 left join f on f.px = m.px "
    "where mon % 4 <> 0 and m.px % 11 <> 0 and col <= 30 and row <= 15"
)
def observations_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of 10 and 20 m, masks and forest as tables of their own, some cells and assets missing, put together again."""
    m = monthly(spark, sf_dir).withColumn("scene_id", F.date_format("scene_ts", catalog.SCENE_ID_FORMAT))
    middle = lambda size: {"x": F.col("col") * size + size / 2, "y": -(F.col("row") * size + size / 2)}
    ten = m.withColumns(middle(10.0))
    half = [F.floor(F.col(c) / 2).cast("long").alias(c) for c in ("row", "col")]
    twenty = m.groupBy("scene_id", *half).agg(F.max("swir").alias("swir"), F.max("rededge").alias("rededge")).where("(row + col) % 3 != 0").withColumns(middle(20.0))
    masks = ten.where("(row * 50 + col) % 11 != 0").select("scene_id", "y", "x", "terrain", "cloud")
    cells = table(spark, sf_dir, "part").where("p_partkey % 7 != 0").select(F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.when(F.col("p_size") % 5 != 0, 1).otherwise(0).alias("forest"))
    keys = F.array(F.lit("a-bands-10m.tif"), F.lit("a-bands-20m.tif"), F.when(F.month("scene_ts") % 4 != 0, "a-masks-10m.tif").otherwise("other"))
    listed = m.select("scene_id", "scene_ts").distinct().withColumn("assets", F.map_from_arrays(keys, F.array_repeat(F.struct(F.lit("u").alias("href")), 3)))
    made = observe.load_observations(ten.select("scene_id", "y", "x", "red", "green", "blue", "nir"), twenty, masks, cells.withColumns(middle(10.0)), (0.0, -150.0, 300.0, 0.0), listed)
    return made.drop("scene_ts", "y", "x")


@query(f"with {SCALED} select {SCENE}, row, col, {PROBA} from scaled")
def run_season_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(pipeline.run_season(monthly(spark, sf_dir), scorer=MODEL))


@query(f"with {SCALED} select {SCENE}, row, col, {PROBA} from scaled where y = {YEAR}")
def run_batch_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a year's scenes, then the rest against the state that the first run kept."""
    obs, folder = monthly(spark, sf_dir), scratch(spark, "state")
    known = obs.select("scene_ts").distinct()
    runs = [pipeline.run_batch(known, obs, folder, f"{YEAR}-01-01", scorer=MODEL, end=f"{YEAR}-{end}") for end in ("06-30", "12-31")]
    return shown(runs[0].unionByName(runs[1]))


@query(f"with {OF_YEAR}, scaled as (select scene_ts, row, col, " + ", ".join(f'("{i}" - "{i}_min") / nullif("{i}_max" - "{i}_min", 0) as "{i}"' for i in INDICES) + f" from vis join kept using (row, col) where scene_ts = timestamp '{YEAR}-07-01') select {SCENE}, row, col, {PROBA} from scaled")
def run_date_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date against the bounds of its whole year."""
    obs, folder = monthly(spark, sf_dir), scratch(spark, "state")
    known = obs.select("scene_ts").distinct()
    pipeline.run_batch(known, obs, folder, f"{YEAR}-01-01", "bounds", end=f"{YEAR}-12-31")
    return shown(pipeline.run_date(spark, known, obs, folder, f"{YEAR}-06-20", MODEL))


@query(f"with {OF_YEAR} select * from kept")
def season_stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All years' rows arrive in three files, so that scenes are split over batches; the bounds are those of one year."""
    obs, path = monthly(spark, sf_dir), scratch(spark, "stream")
    obs.repartition(3, "row", "col").write.parquet(f"{path}/in")
    kinds = ", ".join(f"{c} {t}" for c, t in obs.dtypes)
    stream = season_stream.read_stream(spark, f"{path}/in", kinds, files_per_batch=1)
    season_stream.season_stream(stream, f"{path}/state", f"{path}/checkpoint", YEAR).awaitTermination()
    return state.load_bounds(spark, f"{path}/state", YEAR)


@query(f"with {SCALED} select {SCENE}, row, col, {PROBA}, 1 as band, strftime(scene_ts, '%Y-%m-%d') as date from scaled")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "predictions")
    pipeline.run_season(monthly(spark, sf_dir), scorer=MODEL, sink=path)
    kept = files.read_predictions(spark, path, "part-*")
    return kept.select(F.date_format("scene_ts", "yyyy-MM-dd").alias("scene"), "row", "col", F.round("proba", 6).alias("p"), "band", F.col("date").cast("string").alias("date"))


@query(f"with {SCALED} " + " union all ".join(f"select '{i}' as vi, {SCENE}, row, col, \"{i}\" as value from scaled" for i in INDICES))
def normalized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "normalized")
    pipeline.run_season(monthly(spark, sf_dir), "normalized", sink=path)
    return files.read_normalized(spark, path).select("vi", F.date_format("scene_ts", "yyyy-MM-dd").alias("scene"), "row", "col", "value")


def _page_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key20 = F.when(F.col("page_id") % 5 != 0, "x-bands-20m.tif").otherwise("x-bands-20m.json")
    keys = F.array(F.lit("k-bands-10m.tif"), key20, F.when(F.col("page_id") % 7 != 0, "m-masks-10m.tif").otherwise("m"))
    hrefs = F.array_repeat(F.struct(F.col("url").alias("href")), 3)
    at = F.timestamp_seconds(F.col("page_id") * 3600).cast("timestamp")
    name = F.when(F.col("page_id") % 9 != 0, F.date_format(at, catalog.SCENE_ID_FORMAT)).otherwise(F.concat(F.lit("junk"), F.col("page_id")))
    made = table(spark, sf_dir, "pages").select("page_id", name.alias("scene_id"), F.map_from_arrays(keys, hrefs).alias("assets"))
    return made.withColumn("scene_ts", catalog.parse_scene_id(F.col("scene_id")))


@query(
    "with r as (select case when page_id % 9 <> 0 then strftime(make_timestamp(page_id * 3600000000), '%Y-%m-%dt%H%M%S') else 'junk' || page_id end as scene_id, case when page_id % 9 = 0 then 'no time in the id' "
    "when page_id % 5 = 0 and page_id % 7 = 0 then 'lacks bands_20m, masks_10m' when page_id % 5 = 0 then 'lacks bands_20m' when page_id % 7 = 0 then 'lacks masks_10m' when page_id % 4 = 0 then 'no pixels' end as reason from pages) select * from r where reason is not null"
)
def scene_unusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _page_assets(spark, sf_dir)
    return catalog.unusable_scenes(found, found.where("page_id % 4 != 0")).select("scene_id", "reason")


@query("select page_id, url as href, 'new' as added, 4 as n from pages")
def asset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = catalog.with_asset(catalog.with_asset(_page_assets(spark, sf_dir), "extra.json", "old"), "extra.json", "new")
    return more.select("page_id", F.col("assets")["k-bands-10m.tif"]["href"].alias("href"), F.col("assets")["extra.json"]["href"].alias("added"), F.size("assets").alias("n"))


@query("select event_id, strftime(ts, 'NDVI_%Y-%m-%dt%H%M%S') as name, 'NDVI_' || strftime(ts, '%Y-%m-%dt%H%M%S') as stem, date_trunc('second', ts) as parsed from events")
def result_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = scenes(spark, sf_dir).withColumn("name", catalog.result_name("NDVI", F.col("scene_ts")))
    stem = catalog.file_stem(F.concat(F.lit("a/b.c/"), "name", F.lit(".tif")))
    return named.select("event_id", "name", stem.alias("stem"), catalog.time_in_name(F.col("name")).alias("parsed"))


@query("select user_id, strftime(ts, '%Y-%m-%dt%H%M%S') as scene_id, date_trunc('second', ts) as scene_ts, 'c' as collection, 'u' || event_id as href from events")
def catalogue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as item collections, a line for each user, read back as a catalogue."""
    path = scratch(spark, "catalogue")
    item = F.struct(F.col("scene_id").alias("id"), F.concat(F.lit("c"), F.col("user_id")).alias("collection"), F.create_map(F.lit("a.tif"), F.struct(F.concat(F.lit("u"), "event_id").alias("href"))).alias("assets"))
    scenes(spark, sf_dir).groupBy("user_id").agg(F.collect_list(item).alias("features")).select(F.to_json(F.struct("features"))).write.text(path)
    back = files.read_catalogue(spark, path, lines=True)
    return back.select(F.substring("collection", 2, 20).cast("long").alias("user_id"), "scene_id", "scene_ts", F.lit("c").alias("collection"), F.col("assets")["a.tif"]["href"].alias("href"))


@query("select 's' || vec_id as scene_id, vec_id * 8 + (i - 1) // 8 as row, ((i - 1) % 8)::bigint as col, embedding[i]::double as red from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)")
def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a tile of 8 x 8 cells."""
    tiles = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("s"), "vec_id").alias("scene_id"), (F.col("vec_id") * 8).alias("row0"), F.lit(0).alias("col0"), F.lit(8).alias("width"), F.col("embedding").alias("red"))
    return files.explode_tiles(tiles, ["red"]).select("scene_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("red").cast("double").alias("red"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.floor(F.col("p_partkey") / 50).cast("long").alias("row"), (F.col("p_partkey") % 50).alias("col"), (F.col("p_size") % 4 + 252).cast("double").alias("seed"), "p_size")


@query("select (p_partkey // 50)::bigint as row, (p_partkey % 50)::bigint as col, (p_size % 4 + 252)::double as seed from part where p_size % 4 <> 3")
def template_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template written as GeoTIFF squares of 1024 cells and read again; its empty value is NULL."""
    path = scratch(spark, "template")
    cells = _cells(spark, sf_dir)
    made = grid.template_grid(cells.withColumns({"x": F.col("col") * 10 + 5.0, "y": -(F.col("row") * 10 + 5.0)}))
    files.write_template(made, path, "grid", (0.0, 0.0), 10.0, epsg=2056)
    back = grid.cell_index(files.read_geotiff(spark, f"{path}/*_bbox_template_*.tif", {"seed": 1}), 0.0, 0.0, 10.0)
    return back.where("seed is not null").select("row", "col", F.col("seed").cast("double").alias("seed"))


@query("select timestamp '2018-06-27 10:40:21' as scene_ts, (p_partkey // 50)::bigint as row, (p_partkey % 50)::bigint as col, (p_size / 64.0::double)::float::double as proba from part")
def result_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as GeoTIFF squares and found again by the pattern of their names."""
    path = scratch(spark, "rasters")
    scored = _cells(spark, sf_dir).withColumns({"scene_ts": F.lit("2018-06-27 10:40:21").cast("timestamp"), "proba": F.col("p_size") / 64.0})
    files.export(files.geotiff_tiles(scored, "proba", catalog.result_name("Proba", F.col("scene_ts")), (0.0, 0.0), 10.0, size=64), path)
    back = grid.cell_index(files.scan_results(spark, path), 0.0, 0.0, 10.0)
    return back.where("proba is not null").select(F.col("scene_ts").cast("timestamp_ntz").alias("scene_ts"), "row", "col", F.col("proba").cast("double").alias("proba"))


@query(
    "with t as (select ts as target_ts from events where event_id % 2 = 0), s as (select ts from events where event_id % 2 = 1), b as (select target_ts, s.ts as back from t asof left join s on target_ts >= s.ts), "
    "a as (select b.*, s.ts as ahead from b asof left join s on target_ts <= s.ts) select target_ts, case when ahead is null or abs(epoch_us(back) - epoch_us(target_ts)) <= abs(epoch_us(ahead) - epoch_us(target_ts)) then back else ahead end as nearest_ts from a"
)
def scene_closest_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All targets and scenes under one key."""
    every = scenes(spark, sf_dir).withColumn("k", F.lit(1))
    asked = every.where("event_id % 2 = 0").select("k", F.col("scene_ts").alias("target_ts"))
    return catalog.closest_per_key(asked, every.where("event_id % 2 = 1"), ["k"], days=4).select("target_ts", "nearest_ts")


@query("select (select count(*) from (select distinct ts from events)) as n_scenes, count(*) as n_new, (select count(*) from (select distinct ts from events)) - count(*) as n_processed from (select distinct ts from events where user_id % 3 <> 0) e where not exists (select 1 from events o where o.user_id % 3 = 0 and date_trunc('second', o.ts) = date_trunc('second', e.ts))")
def scene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = scenes(spark, sf_dir)
    done = every.where("user_id % 3 = 0").select(catalog.iso(F.col("scene_ts")).alias("processed_date"))
    return catalog.scene_counts(every, done)


@query(f"with {OF_YEAR} select k.*, (select string_agg(d, ',' order by d) from (select distinct strftime(scene_ts, '%Y-%m-%dT%H:%M:%S') as d from vis where y = {YEAR})) as dates, 2::bigint as version from kept k")
def state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and progress as two runs have left them in a state folder."""
    obs, folder = monthly(spark, sf_dir), scratch(spark, "state")
    for end in ("06-30", "12-31"):
        pipeline.run_batch(obs.select("scene_ts").distinct(), obs, folder, f"{YEAR}-01-01", "bounds", end=f"{YEAR}-{end}")
    meta = state.load_meta(spark, folder, YEAR).select(F.array_join("processed_dates", ",").alias("dates"), "version")
    return state.load_bounds(spark, folder, YEAR).join(F.broadcast(meta), F.lit(True))  # one row


@query(f"with {SCALED} select {SCENE}, row, col, {PROBA} from scaled")
def model_json_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of score_logistic read from a JSON file."""
    path = scratch(spark, "model")
    spark.createDataFrame([(json.dumps({"weights": WEIGHTS, "intercept": INTERCEPT}),)], "value string").coalesce(1).write.text(path)
    said = files.read_text_json(spark, path).where("length(json) > 0").first()["json"]
    return shown(pipeline.run_season(monthly(spark, sf_dir), scorer=Logistic.from_json(said)))


@query("select (p_partkey // 50)::bigint as row, (p_partkey % 50)::bigint as col, p_size, ((p_partkey // 50) // 8)::bigint as chunk_row, ((p_partkey % 50) // 8)::bigint as chunk_col from part")
def chunked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = grid.by_chunk(_cells(spark, sf_dir), 8)
    return dealt.select("row", "col", "p_size", F.floor(F.col("row") / 8).alias("chunk_row"), F.floor(F.col("col") / 8).alias("chunk_col"))


@query("select user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at, min(value) over w as v_min, max(value) over w as v_max from events window w as (partition by user_id order by ts rows unbounded preceding)")
def stream_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running bounds of each user from the state store, over one batch of files."""
    path = scratch(spark, "stream")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    made = season_stream.running_by_state(stream, "user_id", "ts", "value")
    season_stream.drain(made, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/checkpoint", "append")
    back = spark.read.parquet(f"{path}/out")
    return back.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "v_min", "v_max")
