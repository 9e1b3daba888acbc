"""A scene catalogue behind HTTP (or saved in files) as a Spark data source, for batches and streams.

    scene_catalogue(spark, ".../search", collection="c", start="2018-03-01", end="2018-09-30")

The address answers with item collections in JSON, whose link "next" names the next page. Where
spark.sql.python.filterPushdown.enabled is on, the query's own conditions on scene_ts and collection go into the request as
well. Each month of the range is a task of its own. Without a range, or with an address that takes no request (file:), one task reads all pages. Rows
are filtered again by Spark, so an answer may hold more than was asked for.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from urllib.parse import urlencode, urljoin
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from leafseason.schema import SCENES
from leafseason.workers import ship

ship(__name__)

#: Fixed value: how scene ids write a time.
ID_FORMAT = "%Y-%m-%dt%H%M%S"


def id_time(scene_id: str) -> dt.datetime | None:
    try:
        return dt.datetime.strptime(scene_id.replace("T", "t"), ID_FORMAT).replace(tzinfo=dt.UTC)
    except ValueError:
        return None


def pages(url: str, asked: dict[str, str]) -> Iterator[dict]:
    """The item collections behind an address, page by page."""
    if not url.startswith("file:") and asked:
        url += ("&" if "?" in url else "?") + urlencode(asked)
    seen = set()
    while url and url not in seen:
        seen.add(url)
        with urlopen(url, timeout=60) as answer:  # noqa: S310  the address is the user's own
            page = json.load(answer)
        yield page
        url = next((urljoin(url, x["href"]) for x in page.get("links", []) if x.get("rel") == "next"), "")


def scenes(url: str, collection: str | None, first: dt.datetime | None, last: dt.datetime | None) -> Iterator[tuple]:
    """Rows of SCENES from first to last, both included."""
    asked = {}
    if collection:
        asked["collections"] = collection
    if first or last:
        asked["datetime"] = "/".join(t.strftime("%Y-%m-%dT%H:%M:%SZ") if t else ".." for t in (first, last))
    for page in pages(url, asked):
        for item in page.get("features", []):
            at = id_time(item["id"])
            if collection and item.get("collection") not in (None, collection):
                continue
            if at and ((first and at < first) or (last and at > last)):
                continue
            yield item["id"], at, item.get("collection"), {k: (v.get("href"),) for k, v in item.get("assets", {}).items()}


def days(text: str | None, end: bool) -> dt.datetime | None:
    """The first moment of a date, or its last second."""
    if text is None:
        return None
    day = dt.datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=dt.UTC)
    return day + dt.timedelta(days=1, seconds=-1) if end else day


class Span(InputPartition):
    def __init__(self, first: dt.datetime | None, last: dt.datetime | None):
        self.first, self.last = first, last


def spans(first: dt.datetime | None, last: dt.datetime | None) -> list[Span]:
    """A closed range cut at the starts of months."""
    if first is None or last is None:
        return [Span(first, last)]
    out = []
    while first <= last:
        after = (first.replace(day=1, hour=0, minute=0, second=0, microsecond=0) + dt.timedelta(days=32)).replace(day=1)
        out.append(Span(first, min(last, after - dt.timedelta(seconds=1))))
        first = after
    return out


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.collection = options["url"], options.get("collection")
        self.first, self.last = days(options.get("start"), False), days(options.get("end"), True)

    def partitions(self):
        return [Span(self.first, self.last)] if self.url.startswith("file:") else spans(self.first, self.last)

    def read(self, partition):
        yield from scenes(self.url, self.collection, partition.first, partition.last)


class PushingReader(CatalogueReader):
    """A reader that takes filters, which Spark allows only where pushdown is on."""

    def pushFilters(self, filters):
        """Narrow the range by what the query asks; Spark filters what comes once more."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("collection",) and isinstance(f, EqualTo) and self.collection is None:
                self.collection = value
            if getattr(f, "attribute", None) == ("scene_ts",) and isinstance(value, dt.datetime):
                at = value if value.tzinfo else value.astimezone(dt.UTC)
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    low = at.replace(microsecond=0)
                    self.first = max(self.first or low, low)
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.last = min(self.last or at, at)
            yield f


class CatalogueStream(SimpleDataSourceStreamReader):
    """Each trigger asks for the whole range and sends the scenes not sent before, however late; the offset is what was sent."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self):
        return {"sent": []}

    def _all(self) -> dict[str, tuple]:
        o = self.options
        return {r[0]: r for r in scenes(o["url"], o.get("collection"), days(o.get("start"), False), days(o.get("end"), True))}

    def read(self, start):
        now = self._all()
        fresh = sorted(set(now) - set(start["sent"]))
        return iter([now[k] for k in fresh]), {"sent": sorted({*start["sent"], *fresh})}

    def readBetweenOffsets(self, start, end):
        now = self._all()
        return iter([now[k] for k in sorted(set(end["sent"]) - set(start["sent"])) if k in now])


class SceneCatalogue(DataSource):
    """Options: url; collection, start and end (dates, both included) narrow what is asked for; pushdown: true takes filters."""

    @classmethod
    def name(cls) -> str:
        return "scene_catalogue"

    def schema(self) -> str:
        return SCENES

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else CatalogueReader)(dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return CatalogueStream(dict(self.options))


def scene_catalogue(spark: SparkSession, url: str, stream: bool = False, **options: str) -> DataFrame:
    """The scenes behind an address, as a table or, with stream, as a stream of scenes not sent before."""
    spark.dataSource.register(SceneCatalogue)
    reader = (spark.readStream if stream else spark.read).format("scene_catalogue").options(url=url, **options)
    return reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load()
