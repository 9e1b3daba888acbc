"""One query for each operator over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafseason.functions.arithmetic import finite, null_to_sentinel
from leafseason.functions.indices import with_indices
from leafseason.operators import catalog, grid, mask, season, summary
from leafseason.operators.score import ArrowModel, Logistic, LogisticModel, every, feature_frame, score
from leafseason.plans.adapter import KEYS, OBS, observations, table
from leafseason.schema import FEATURES, INDICES, NODATA
from leafseason.sources.scratch import scratch
from leafseason.streaming import season_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: An invented model: the real one is not public.
WEIGHTS = {FEATURES[i]: w for i, w in {"CCI": 0.3, "EVI": -0.7, "CIRE": 0.2, "NDMI": -1.1, "NDVI": -0.9}.items()}
INTERCEPT = 1.0
ORDER = ["ts", "k1", "k2", "k3"]
SPLIT = "1998-06-01"
SQL_KEYS = "px, ts, k1, k2, k3"

VI_SQL = {
    "NDVI": "(nir - red) / {z}(nir + red{e})",
    "EVI": "case when nir = red and nir + 6 * red - 7.5::double * blue + 1 <> 0 then 0 else 2.5::double * ((nir - red) / {z}(nir + 6 * red - 7.5::double * blue + 1{e})) end",
    "NDMI": "(nir - swir) / {z}(nir + swir{e})",
    "CIRE": "nir / {z}(rededge{e}) - 1",
    "CCI": "(green - red) / {z}(green + red{e})",
}
PLAIN = {k: v.format(z="nullif", e=", 0") for k, v in VI_SQL.items()}
SIGNED = {k: v.format(z="", e="") for k, v in VI_SQL.items()}
MASKED = f"{OBS}, vis as (select {SQL_KEYS}, valid, " + ", ".join(f'case when valid then {v} end as "{k}"' for k, v in PLAIN.items()) + " from obs)"
PAST = "over (partition by px order by ts, k1, k2, k3 rows unbounded preceding)"
RUNNING = f"{MASKED}, bounds as (select *, " + ", ".join(f'{e}("{i}") {PAST} as "{i}_{e}"' for i in INDICES for e in ("min", "max")) + " from vis)"
SCALED = f"{RUNNING}, scaled as (select {SQL_KEYS}, " + ", ".join(f'("{i}" - "{i}_min") / nullif("{i}_max" - "{i}_min", 0) as "{i}"' for i in INDICES) + " from bounds)"
COMPLETE = " and ".join(f'"{i}" is not null' for i in INDICES)
Z = '0.3 * "CCI" - 0.7 * "EVI" + 0.2 * "CIRE" - 1.1 * "NDMI" - 0.9 * "NDVI" + 1.0'
SCORED = f"{SCALED}, scored as (select {SQL_KEYS}, case when {COMPLETE} then 1 / (1 + exp(-({Z}))) end as proba from scaled)"
BOUND_NAMES = [f"{i}_{e}" for i in INDICES for e in ("min", "max")]


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def valid_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.with_valid(observations(spark, sf_dir))


def masked_vis(spark: SparkSession, sf_dir: str, infinities: bool = False) -> DataFrame:
    return mask.masked(with_indices(valid_obs(spark, sf_dir), infinities=infinities), INDICES).select(*KEYS, "valid", *INDICES)


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.running_bounds(masked_vis(spark, sf_dir), ["px"], ORDER)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_frame(season.normalized(running(spark, sf_dir)), KEYS)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scenes, with ids that write their second."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("scene_ts"), F.date_format("ts", catalog.SCENE_ID_FORMAT).alias("scene_id"), "value")


def _vi(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return with_indices(observations(spark, sf_dir)).select(*KEYS, F.col(name).alias("vi"))

    run.__name__ = f"vi_{name.lower()}"
    query(f"with {OBS} select {SQL_KEYS}, {PLAIN[name]} as vi from obs")(run)


for _name in INDICES:
    _vi(_name)


@query(f"with {OBS} select {SQL_KEYS}, case when isfinite({SIGNED['CIRE']}) then {SIGNED['CIRE']} end as vi from obs")
def vi_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_indices(observations(spark, sf_dir), infinities=True).select(*KEYS, finite(F.col("CIRE")).alias("vi"))


@query(f"with {OBS} select {SQL_KEYS}, valid from obs")
def valid_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_obs(spark, sf_dir).select(*KEYS, "valid")


@query(f"with {OBS} select {SQL_KEYS}, cloud, cloud is distinct from 1 as clear from obs where cloud is null or cloud = 1")
def mask_nodata_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).where("cloud is null or cloud = 1")
    return obs.select(*KEYS, "cloud", mask.valid_pixel(F.col("cloud"), F.lit(0), F.lit(1), F.lit(1)).alias("clear"))


@query(f'with {MASKED} select {SQL_KEYS}, valid, "NDVI", "EVI", "NDMI", "CIRE", "CCI" from vis')
def masked_vi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_vis(spark, sf_dir)


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem where exists (select 1 from part where p_partkey = l_partkey and p_size % 5 <> 0)")
def forest_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = table(spark, sf_dir, "part").where("p_size % 5 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(forest, "l_partkey", "left_semi")


@query(f"with {OBS}, spot as (select {SQL_KEYS}, (px % 50) * 10.0::double + 5 as x, (px // 50) * 10.0::double + 5 as y from obs) select * from spot where x between 95 and 305 and y between 45 and 205")
def bbox_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = {"x": F.col("px") % 50 * 10.0 + 5, "y": F.floor(F.col("px") / 50) * F.lit(10.0) + 5}
    return grid.clip(observations(spark, sf_dir).select(*KEYS).withColumns(place), (100.0, 50.0, 300.0, 200.0), cell=10.0)


@query(f"with {OBS} select p_partkey as px, nullif(p_size % 4 + 252, 255)::double as seed, ts, k1, k2, k3, nir from part left join (select * from obs where valid) o on p_partkey = px")
def template_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("px"), (F.col("p_size") % 4 + 252).cast("double").alias("seed"))
    own = valid_obs(spark, sf_dir).where("valid").select(*KEYS, "nir")
    return grid.on_grid(grid.template_grid(cells), own, ["px"]).select("px", "seed", "ts", "k1", "k2", "k3", "nir")


@query(
    "with fine as (select p_partkey, (p_partkey // 50)::bigint as row, (p_partkey % 50)::bigint as col from part), "
    "coarse as (select row // 2 as r, col // 2 as c, max(p_size) as swir from fine join part using (p_partkey) where row % 2 = 0 and col % 2 = 0 group by all) "
    "select p_partkey, row, col, swir from fine left join coarse on row // 2 = r and col // 2 = c"
)
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 50).cast("long").alias("row"), (F.col("p_partkey") % 50).cast("long").alias("col"), "p_size")
    half = {c: F.floor(F.col(c) / 2).cast("long") for c in ("row", "col")}
    coarse = fine.where("row % 2 = 0 and col % 2 = 0").withColumns(half).groupBy("row", "col").agg(F.max("p_size").alias("swir"))
    return grid.resample_nearest(fine.drop("p_size"), coarse, 2).select("p_partkey", "row", "col", "swir")


@query(f"with {MASKED} select px, " + ", ".join(f'{e}("{i}") as "{i}_{e}"' for i in INDICES for e in ("min", "max")) + " from vis group by px")
def season_minmax_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.final_bounds(masked_vis(spark, sf_dir), ["px"])


@query(f"with {RUNNING} select {SQL_KEYS}, " + ", ".join(f'"{b}"' for b in BOUND_NAMES) + " from bounds")
def season_minmax_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running(spark, sf_dir).select(*KEYS, *BOUND_NAMES)


_RESET = (
    f"with {OBS}, v as (select {SQL_KEYS}, case when valid then {SIGNED['CIRE']} end as c, case when valid then {SIGNED['EVI']} end as e from obs), "
    f"g as (select *, count(*) filter (c = '-inf'::double) {PAST} as cl, count(*) filter (c = 'inf'::double) {PAST} as ch, "
    f"count(*) filter (e = '-inf'::double) {PAST} as el, count(*) filter (e = 'inf'::double) {PAST} as eh from v), r as (select {SQL_KEYS}"
    + "".join(f", {f}(case when isfinite({c}) then {c} end) over (partition by px, {g} order by ts, k1, k2, k3 rows unbounded preceding) as \"{n}\"" for f, c, g, n in (("min", "c", "cl", "CIRE_min"), ("max", "c", "ch", "CIRE_max"), ("min", "e", "el", "EVI_min"), ("max", "e", "eh", "EVI_max")))
    + " from g)"
)


@query(_RESET + " select * from r")
def season_minmax_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    vis = masked_vis(spark, sf_dir, infinities=True)
    out = season.running_bounds(vis, ["px"], ORDER, ["CIRE", "EVI"], inf_policy="reset")
    return out.select(*KEYS, "CIRE_min", "CIRE_max", "EVI_min", "EVI_max")


@query(_RESET + ' select px, arg_max(coalesce("CIRE_min", -9e9), (ts, k1, k2, k3)) as cire_min, arg_max(coalesce("CIRE_max", -9e9), (ts, k1, k2, k3)) as cire_max from r group by px')
def season_minmax_reset_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = season.final_bounds(masked_vis(spark, sf_dir, infinities=True), ["px"], ["CIRE"], "reset", ORDER)
    return out.select("px", null_to_sentinel(F.col("CIRE_min"), -9e9).alias("cire_min"), null_to_sentinel(F.col("CIRE_max"), -9e9).alias("cire_max"))


@query(
    f"with {MASKED}, seed as (select p_partkey as px, case when p_size % 4 <> 3 then p_size / 100.0::double end as s from part) "
    f'select {SQL_KEYS}, least(s, min("NDVI") {PAST}) as "NDVI_min", greatest(s, max("NDVI") {PAST}) as "NDVI_max" from vis join seed using (px)'
)
def season_minmax_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("p_size") % 4 != 3, F.col("p_size") / 100.0)
    seed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("px"), value.alias("NDVI_min"), value.alias("NDVI_max"))
    return season.running_bounds(masked_vis(spark, sf_dir), ["px"], ORDER, ["NDVI"], seed=seed).select(*KEYS, "NDVI_min", "NDVI_max")


@query(f'with {MASKED} select px, min("NDVI") as "NDVI_min", max("NDVI") as "NDVI_max", min("CCI") as "CCI_min", max("CCI") as "CCI_max" from vis group by px')
def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    vis, which = masked_vis(spark, sf_dir), ["NDVI", "CCI"]
    early, late = (season.final_bounds(vis.where(c), ["px"], which) for c in (f"ts < '{SPLIT}'", f"ts >= '{SPLIT}'"))
    return season.merge_bounds(early, late, ["px"], which)


@query(f"with {MASKED} " + " union all ".join(f"select px, '{i}' as vi, min(\"{i}\") as vi_min, max(\"{i}\") as vi_max from vis group by px" for i in INDICES))
def state_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.long_bounds(season.final_bounds(masked_vis(spark, sf_dir), ["px"]), ["px"])


@query(f'with {SCALED} select {SQL_KEYS}, "NDVI", "EVI", "NDMI", "CIRE", "CCI" from scaled')
def normalize_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.normalized(running(spark, sf_dir)).select(*KEYS, *INDICES)


@query(
    f'with {MASKED}, b as (select px, min("NDVI") as lo, max("NDVI") as hi, min("CCI") as lo2, max("CCI") as hi2 from vis where ts < \'{SPLIT}\' group by px) '
    f'select {SQL_KEYS}, ("NDVI" - lo) / nullif(hi - lo, 0) as "NDVI", ("CCI" - lo2) / nullif(hi2 - lo2, 0) as "CCI" from vis join b using (px) where ts >= \'{SPLIT}\''
)
def normalize_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    vis, which = masked_vis(spark, sf_dir), ["NDVI", "CCI"]
    kept = season.final_bounds(vis.where(f"ts < '{SPLIT}'"), ["px"], which)
    return season.normalized(vis.where(f"ts >= '{SPLIT}'").join(kept, "px"), which).select(*KEYS, *which)


_FEATURES = ", ".join(f'"{i}" as "{f}"' for i, f in FEATURES.items())


@query(f"with {SCALED} select {SQL_KEYS}, {_FEATURES} from scaled")
def feature_frame_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir)


@query(f"with {SCALED} select {SQL_KEYS}, {_FEATURES} from scaled where {COMPLETE}")
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).where(every([F.col(f).isNotNull() for f in FEATURES.values()]))


@query(f"with {SCORED} select {SQL_KEYS}, round(proba, 6) as p from scored where proba is not null")
def score_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = score(features(spark, sf_dir), Logistic(WEIGHTS, INTERCEPT))
    return done.where("proba is not null").select(*KEYS, F.round("proba", 6).alias("p"))


@query(f"with {SCORED} select {SQL_KEYS}, round(proba, 6) as p from scored")
def score_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = score(features(spark, sf_dir), ArrowModel(LogisticModel(WEIGHTS, INTERCEPT)))
    return done.select(*KEYS, F.round("proba", 6).alias("p"))


@query(f"with {SCORED} select {SQL_KEYS}, (case when proba is null then {NODATA} when proba > 0.5 then 1 else 0 end)::int as label from scored")
def score_label_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(features(spark, sf_dir), Logistic(WEIGHTS, INTERCEPT), mode="label").select(*KEYS, "label")


@query("select event_id, ts as scene_ts from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-21'")
def scene_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.scenes_between(scenes(spark, sf_dir), "2024-01-05", "2024-01-20").select("event_id", "scene_ts")


@query("select event_id, strftime(ts, '%Y-%m-%dt%H%M%S') as scene_id, date_trunc('second', ts) as parsed, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from events")
def scene_parse_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = scenes(spark, sf_dir).withColumn("parsed", catalog.parse_scene_id(F.col("scene_id")))
    return parsed.select("event_id", "scene_id", "parsed", catalog.iso(F.col("parsed")).alias("iso"))


@query(
    "select ts as scene_ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from (select distinct ts from events) e "
    "where not exists (select 1 from events o where o.user_id % 3 = 0 and strftime(o.ts, '%Y-%m-%dT%H:%M:%S') = strftime(e.ts, '%Y-%m-%dT%H:%M:%S'))"
)
def scene_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    every_scene = scenes(spark, sf_dir)
    done = every_scene.where("user_id % 3 = 0").select(catalog.iso(F.col("scene_ts")).alias("processed_date"))
    return catalog.new_scenes(every_scene, done).select("scene_ts", catalog.iso(F.col("scene_ts")).alias("iso"))


@query("select event_id, ts as scene_ts from events where ts >= timestamp '2024-01-15' - interval 100 day order by abs(epoch_us(ts) - epoch_us(timestamp '2024-01-15')), ts limit 1")
def scene_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The driver's events lie in January; they are moved by 91 days into the season of the search, and back.
    moved = scenes(spark, sf_dir).withColumn("scene_ts", F.expr("scene_ts + interval 91 days"))
    return catalog.closest_scene(moved, "2024-04-15").select("event_id", F.expr("scene_ts - interval 91 days").alias("scene_ts"))


@query(
    "with t as (select user_id, timestamp '2024-01-01' + to_days((user_id % 30)::int) as target_ts from (select distinct user_id from events)), "
    "m as (select t.user_id, target_ts, ts, row_number() over (partition by t.user_id order by abs(epoch_us(ts) - epoch_us(target_ts)), ts) as rn from t join events e on e.user_id = t.user_id) "
    "select user_id, target_ts, ts as nearest_ts, abs(epoch_us(ts) - epoch_us(target_ts)) as gap_micros from m where rn = 1"
)
def scene_closest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    every_scene = scenes(spark, sf_dir)
    at = F.timestamp_add("DAY", (F.col("user_id") % 30).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return catalog.closest_per_key(every_scene.select("user_id").distinct().withColumn("target_ts", at), every_scene, ["user_id"])


@query(
    "select user_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(list(strftime(ts, '%Y-%m-%d')) filter (event_id % 2 = 0), []), coalesce(list(strftime(ts, '%Y-%m-%d')) filter (event_id % 2 = 1), [])))), ',') as dates "
    "from events group by user_id"
)
def processed_dates_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    halves = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.collect_set(F.when(F.col("event_id") % 2 == k, day)).alias(n) for k, n in enumerate(("old", "new"))))
    return halves.select("user_id", F.array_join(catalog.processed_union(F.col("old"), F.col("new")), ",").alias("dates"))


@query(
    "with a as (select page_id, 'k' || page_id % 3 || '-bands-10m.tif' as a10, case when page_id % 5 <> 0 then 'x-bands-20m.tif' else 'x-bands-20m.json' end as a20, 'm-masks-10m.tif' as m10, url from pages) "
    "select page_id, case when ends_with(a10, 'bands-10m.tif') then url || '#1' end as bands_10m, case when ends_with(a20, 'bands-20m.tif') then url || '#2' end as bands_20m, "
    "case when ends_with(m10, 'masks-10m.tif') then url || '#3' end as masks_10m, ends_with(a20, 'bands-20m.tif') as usable from a"
)
def asset_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    key20 = F.when(F.col("page_id") % 5 != 0, "x-bands-20m.tif").otherwise("x-bands-20m.json")
    keys = F.array(F.concat(F.lit("k"), F.col("page_id") % 3, F.lit("-bands-10m.tif")), key20, F.lit("m-masks-10m.tif"))
    hrefs = F.array(*(F.struct(F.concat("url", F.lit(f"#{k}")).alias("href")) for k in (1, 2, 3)))
    found = catalog.resolve_assets(table(spark, sf_dir, "pages").withColumn("assets", F.map_from_arrays(keys, hrefs)))
    return found.select("page_id", *catalog.ASSETS, "usable")


@query(
    "with e as (select event_id, cast(props->>'k' as bigint) as k from events) "
    "select 'BANDS-10M' as \"group\", 'B' || k as band_id from e union all select 'BANDS-20M', 'C' || event_id from e where event_id % 2 = 0"
)
def json_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda v: F.array(F.struct(v.alias("id")))
    k = F.get_json_object("props", "$.k")
    twenty = F.when(F.col("event_id") % 2 == 0, F.struct(one(F.concat(F.lit("C"), F.col("event_id"))).alias("BANDS")))
    said = F.to_json(F.struct(F.struct(one(F.concat(F.lit("B"), k)).alias("BANDS")).alias("BANDS-10M"), twenty.alias("BANDS-20M")))
    return catalog.band_ids(table(spark, sf_dir, "events").select(said.alias("json")))


@query("select vec_id, " + ", ".join(f"embedding[{k + 1}] as {b}" for k, b in enumerate(("red", "green", "blue", "nir", "swir", "rededge"))) + " from embeddings")
def band_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.element_at("embedding", k + 1).alias(b) for k, b in enumerate(("red", "green", "blue", "nir", "swir", "rededge"))))


def scored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = score(features(spark, sf_dir), Logistic(WEIGHTS, INTERCEPT))
    return done.select(F.date_format("ts", "yyyy-MM").alias("scene_ts"), F.round("proba", 6).alias("proba"))


@query(f"with {SCORED} select strftime(ts, '%Y-%m') as scene_ts, count(proba) as n_pixels from scored group by 1 having count(proba) >= 100")
def scene_pixel_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.scored_scenes(scored_days(spark, sf_dir))


@query(f"with {SCORED} select strftime(ts, '%Y-%m') as scene_ts, count(proba) as n_pixels, round(avg(round(proba, 6)), 12) as mean_proba, min(round(proba, 6)) as min_proba, max(round(proba, 6)) as max_proba from scored group by 1")
def season_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.season_summary(scored_days(spark, sf_dir)).withColumn("mean_proba", F.round("mean_proba", 12))


@query("select user_id, min(value) as v_min, max(value) as v_max from events group by user_id")
def stream_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "stream")
    kinds = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kinds).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern it may be a file or a folder
    sent = season_stream.minmax_updates(stream, "user_id", "value")
    season_stream.drain(sent, lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/checkpoint")
    rows = spark.read.schema("user_id long, v_min double, v_max double, batch long").parquet(f"{path}/out")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("v_min", "v_max"), "batch").alias("v")).select("user_id", "v.v_min", "v.v_max")


@query("select user_id, min(ts) as first_ts from events group by user_id")
def stream_new_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "stream")
    kinds = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kinds).parquet(f"{sf_dir}/events.parque[t]").select("user_id", "ts")
    scenes = season_stream.first_seen(stream, "user_id", "ts")  # a scene is known by its time; late ones may be a user's first
    season_stream.drain(scenes, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/checkpoint", "append")
    return spark.read.schema("user_id long, ts timestamp").parquet(f"{path}/out").groupBy("user_id").agg(F.min("ts").alias("first_ts"))
