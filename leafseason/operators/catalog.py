"""Scene catalogue: parsing, ranges, new and nearest scenes, assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How scene ids and state keys write a time, and the endings of the assets that a scene needs.
SCENE_ID_FORMAT = "yyyy-MM-dd't'HHmmss"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
ASSETS = {"bands_10m": "bands-10m.tif", "bands_20m": "bands-20m.tif", "masks_10m": "masks-10m.tif"}


def parse_scene_id(scene_id: Column) -> Column:
    """The time in a scene id, NULL if it holds none; the day and the time may be parted by t or T."""
    return F.try_to_timestamp(F.translate(scene_id, "T", "t"), F.lit(SCENE_ID_FORMAT))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)


def season(year: int, start: str | None = None, end: str | None = None) -> tuple[str, str]:
    """Dates of a season, from March to September unless given."""
    return start or f"{year}-03-01", end or f"{year}-09-30"


def season_year(start: str) -> int:
    return int(start.split("-")[0])


def scenes_between(scenes: DataFrame, start: str, end: str, collection: str | None = None) -> DataFrame:
    """Scenes from the first moment of start to the last of end, in order of time."""
    inside = (F.col("scene_ts") >= F.lit(start).cast("timestamp")) & (F.col("scene_ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    if collection is not None:
        inside &= F.col("collection") == collection
    return scenes.where(inside).orderBy("scene_ts")


def new_scenes(scenes: DataFrame, processed: DataFrame) -> DataFrame:
    """Scenes whose time is not among processed (column processed_date, as ISO text); each time once."""
    fresh = scenes.dropDuplicates(["scene_ts"]).withColumn("__iso", iso(F.col("scene_ts")))
    return fresh.join(processed.select(F.col("processed_date").alias("__iso")), "__iso", "left_anti").drop("__iso")


def scene_counts(scenes: DataFrame, processed: DataFrame) -> DataFrame:
    """One row (n_scenes, n_processed, n_new) of the scenes by time."""
    n = scenes.agg(F.count_distinct("scene_ts").alias("n_scenes"))
    fresh = new_scenes(scenes, processed).agg(F.count("*").alias("n_new"))
    return n.crossJoin(fresh).select("n_scenes", (F.col("n_scenes") - F.col("n_new")).alias("n_processed"), "n_new")  # one row by one row


def closest_scene(scenes: DataFrame, target: str) -> DataFrame:
    """The scene of April to September of the target's year nearest to the target's midnight; ties to the earlier. Empty if none."""
    year = season_year(target)
    near = scenes_between(scenes, f"{year}-04-01", f"{year}-09-30")
    gap = F.abs(micros("scene_ts") - micros(F.lit(target)))
    return near.orderBy(gap, "scene_ts").limit(1)


def closest_per_key(targets: DataFrame, scenes: DataFrame, keys: list[str], target_ts: str = "target_ts", scene_ts: str = "scene_ts", days: int = 32) -> DataFrame:
    """For each target its key's nearest scene in time (ties to the earlier), as columns nearest_ts and gap_micros.

    An as-of join in both directions without pairs: targets and scenes meet in one window in order of time. Windows go by key
    and span of `days`, so a key of any size is spread over tasks; each span gets the last scene before it and the first one
    after it from a summary of one row a key and span. Targets and scenes without a time find nothing; null keys are a key.
    """
    span = lambda c: F.floor(F.unix_date(F.to_date(c)) / days)
    kind = scenes.schema[scene_ts].dataType
    a = targets.select(*keys, F.col(target_ts).alias("__ts"), span(target_ts).alias("__span"), F.lit(True).alias("__asks"), F.lit(None).cast(kind).alias("__scene"))
    b = scenes.where(F.col(scene_ts).isNotNull()).select(*keys, F.col(scene_ts).alias("__ts"), span(scene_ts).alias("__span"), F.lit(False).alias("__asks"), F.col(scene_ts).alias("__scene"))
    rows = a.unionByName(b)
    spans = rows.groupBy(*keys, "__span").agg(F.min("__scene").alias("first"), F.max("__scene").alias("last"))
    others = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    beyond = spans.withColumns({"first": F.last("first", True).over(others(F.desc("__span"))), "last": F.last("last", True).over(others("__span"))})
    guests = beyond.select(*keys, "__span", F.explode(F.array("first", "last")).alias("__scene")).where("__scene is not null and __span is not null")
    rows = rows.unionByName(guests.withColumns({"__ts": F.col("__scene"), "__asks": F.lit(False)}))
    # Both frames end at the present row, so each row extends the one before; scenes at the same time are seen by both.
    so_far = lambda order: F.last("__scene", True).over(Window.partitionBy(*keys, "__span").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    met = rows.withColumns({"__back": so_far("__ts"), "__ahead": so_far(F.desc("__ts"))}).where("__asks")
    gap = lambda c: F.abs(micros(c) - micros("__ts"))
    nearest = F.when(F.col("__ahead").isNull() | (gap("__back") <= gap("__ahead")), F.col("__back")).otherwise(F.col("__ahead"))
    return met.withColumn("nearest_ts", F.when(F.col("__ts").isNotNull(), nearest)).select(*keys, F.col("__ts").alias(target_ts), "nearest_ts", gap("nearest_ts").alias("gap_micros"))


def unusable_scenes(scenes: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    """(scene_id, scene_ts, reason): scenes that a run passes over and tries again, with what they lack.

    obs: the pixels that were found; a scene with all assets but without any pixel (outside the box, say) is listed too.
    """
    found = resolve_assets(scenes)
    lacks = F.array_join(F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in ASSETS))), ", ")
    reason = F.when(F.col("scene_ts").isNull(), F.lit("no time in the id")).when(~F.col("usable"), F.concat(F.lit("lacks "), lacks))
    if obs is not None:
        seen = obs.select(F.col("scene_ts").alias("__seen")).distinct()
        found = found.join(seen, F.col("scene_ts") == F.col("__seen"), "left")
        reason = reason.when(F.col("__seen").isNull(), F.lit("no pixels"))
    return found.withColumn("reason", reason).where("reason is not null").select("scene_id", "scene_ts", "reason")


def resolve_assets(scenes: DataFrame, endings: dict[str, str] | None = None) -> DataFrame:
    """Hrefs of the assets whose keys have the wanted endings (the first key in order of text), one column each, and usable: all are there."""
    hrefs = {}
    for name, ending in (endings or ASSETS).items():
        end = F.lit(ending)
        fits = F.map_filter("assets", lambda k, _: F.endswith(k, end))  # noqa: B023  built at once
        first = F.try_element_at(F.array_sort(F.map_keys(fits)), F.lit(1))
        hrefs[name] = F.when(first.isNotNull(), F.try_element_at(F.col("assets"), first)["href"])
    found = scenes.withColumns(hrefs)
    usable = F.lit(True)
    for name in hrefs:
        usable &= F.col(name).isNotNull()
    return found.withColumn("usable", usable)


def band_ids(described: DataFrame, json_col: str = "json") -> DataFrame:
    """(group, band_id) of a band description in JSON. Absent groups have no rows."""
    groups = ("BANDS-10M", "BANDS-20M", "MASKS-10M", "CLOUDPROBABILITY-10M")
    schema = "struct<" + ", ".join(f"`{g}`: struct<BANDS: array<struct<id: string>>>" for g in groups) + ">"
    said = described.select(F.from_json(json_col, schema).alias("d"))
    every = F.array(*(F.struct(F.lit(g).alias("group"), F.coalesce(F.col("d")[g]["BANDS"], F.array().cast("array<struct<id: string>>")).alias("bands")) for g in groups))
    return said.select(F.explode(every).alias("g")).select("g.group", F.explode("g.bands.id").alias("band_id"))


def processed_union(old: Column, new: Column) -> Column:
    """Sorted union of two arrays of dates; NULL counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(old, none), F.coalesce(new, none)))


def with_asset(scenes: DataFrame, key: str, href: str) -> DataFrame:
    """scenes with one more asset; an asset of that key is replaced."""
    struct = scenes.schema["assets"].dataType.valueType.simpleString()
    more = F.map_from_arrays(F.array(F.lit(key)), F.array(F.struct(F.lit(href).alias("href")).cast(struct)))
    return scenes.withColumn("assets", F.map_concat(F.map_filter("assets", lambda k, _: k != key), more))


def file_stem(path: Column) -> Column:
    """A path's last part without its ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def result_name(what: Column | str, ts: Column) -> Column:
    """The name of a scene's result: what it is and the scene's full time, so that scenes of one day stay apart."""
    return F.concat(F.lit(what) if isinstance(what, str) else what, F.lit("_"), F.date_format(ts, SCENE_ID_FORMAT))


def time_in_name(name: Column) -> Column:
    """The time at the end of a result's name, NULL if there is none."""
    return parse_scene_id(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}[tT]\d{6})$", 1))
