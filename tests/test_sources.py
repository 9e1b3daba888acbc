"""GeoTIFF files and the catalogue source."""

import datetime as dt
import json
import struct
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from leafseason.sources import catalogue, files, geotiff
from leafseason.streaming import season_stream
from pyspark.sql import functions as F

T = dt.datetime


@pytest.mark.parametrize("kind", ["uint8", "int16", "float32", "float64"])
def test_round_trip(kind):
    rng = np.random.default_rng(1)
    image = (rng.normal(size=(3, 150, 70)) * 50).astype(kind)
    r = geotiff.Raster(geotiff.encode(image, 100.0, 900.0, 10.0, -9999.0, 2056))
    assert np.array_equal(r.read(), image) and r.dtype.itemsize == image.dtype.itemsize
    assert (r.nodata, r.epsg, r.origin, r.cell) == (-9999.0, 2056, (100.0, 900.0), (10.0, 10.0))
    x, y = r.centre(np.array([0]), np.array([2]))
    assert (x[0], y[0]) == (125.0, 895.0)
    assert sum(b.shape[1] for _, _, b in r.blocks()) == 150


def by_hand(image, order, tile, predictor, apart, compression=8):
    """A tiled file put together bit by bit: image is (row, column, band)."""
    height, width, bands = image.shape
    size, blocks = image.dtype.itemsize, []
    for plane in range(bands if apart else 1):
        part = image[:, :, plane : plane + 1] if apart else image
        for top in range(0, height, tile):
            for left in range(0, width, tile):
                block = np.zeros((tile, tile, part.shape[2]), image.dtype)
                cut = part[top : top + tile, left : left + tile]
                block[: cut.shape[0], : cut.shape[1]] = cut
                if predictor == 2:
                    for c in range(tile - 1, 0, -1):
                        block[:, c] -= block[:, c - 1]
                raw = block.astype(block.dtype.newbyteorder(order)).tobytes()
                if predictor == 3:
                    rows = []
                    for line in block.astype(block.dtype.newbyteorder(">")):
                        by_byte = np.frombuffer(line.tobytes(), np.uint8).reshape(-1, size).T.ravel().astype(int)
                        n = part.shape[2]
                        rows.append(((by_byte - np.concatenate((np.zeros(n, int), by_byte[:-n]))) % 256).astype(np.uint8).tobytes())
                    raw = b"".join(rows)
                blocks.append(zlib.compress(raw) if compression == 8 else raw)
    form = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    at, starts = 8, []
    for b in blocks:
        starts.append(at)
        at += len(b)
    said = [(256, "I", [width]), (257, "I", [height]), (258, "H", [size * 8] * bands), (259, "H", [compression]), (277, "H", [bands]), (284, "H", [2 if apart else 1]), (317, "H", [predictor])]
    said += [(322, "I", [tile]), (323, "I", [tile]), (324, "I", starts), (325, "I", [len(b) for b in blocks]), (339, "H", [form] * bands)]
    entries, extra = b"", b""
    for tag, code, values in said:
        data = struct.pack(f"{order}{len(values)}{code}", *values)
        place = data.ljust(4, b"\0")
        if len(data) > 4:
            place = struct.pack(order + "I", at + 6 + 12 * len(said) + len(extra))
            extra += data
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[code], len(values)) + place
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + b"".join(blocks) + struct.pack(order + "H", len(said)) + entries + b"\0" * 4 + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("kind", "predictor"), [("uint16", 1), ("uint16", 2), ("int32", 2), ("float32", 1), ("float32", 3), ("float64", 3)])
@pytest.mark.parametrize(("apart", "compression"), [(False, 8), (True, 8), (False, 1)])
def test_tiles_orders_and_predictors(order, kind, predictor, apart, compression):
    image = (np.random.default_rng(2).normal(size=(37, 21, 2)) * 90).astype(kind)
    r = geotiff.Raster(by_hand(image, order, 16, predictor, apart, compression))
    assert np.array_equal(r.read().transpose(1, 2, 0), image)
    assert r.nodata is None and r.epsg is None


def test_what_is_not_understood():
    with pytest.raises(ValueError, match="TIFF"):
        geotiff.Raster(b"GIF89a  ")
    image = np.zeros((4, 4, 1), np.uint8)
    with pytest.raises(ValueError, match="compression 5"):
        geotiff.Raster(by_hand(image, "<", 16, 1, False, 5))


def test_rasters_through_spark(spark, tmp_path):
    rows = [("s", r, c, None if (r + c) % 5 == 0 else r + c / 100) for r in range(-3, 70) for c in range(50)]
    df = spark.createDataFrame(rows, "name string, row long, col long, v double")
    out = str(tmp_path / "t")
    files.export(files.geotiff_tiles(df, "v", F.col("name"), (1000.0, 5000.0), 20.0, size=32, epsg=2056), out)
    got = files.read_geotiff(spark, f"{out}/s_*.tif", {"v": 1}).where("v is not null")
    place = {((5000.0 - r.y) / 20 - 0.5, (r.x - 1000.0) / 20 - 0.5): r.v for r in got.collect()}
    assert place == {(r, c): np.float32(v) for _, r, c, v in rows if v is not None}


ITEMS = [("2018-04-30t100000", "c"), ("2018-05-01T000000", "c"), ("2018-05-31t235959", "c"), ("2018-06-02t100000", "c"), ("2018-06-03t100000", "other"), ("odd", "c")]


@pytest.fixture
def served():
    """An address that answers two items a page, for the range and collection asked, and what it was asked."""
    asked, items = [], list(ITEMS)

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            asked.append(q)
            first, last = ([None if x == ".." else T.strptime(x, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=dt.UTC) for x in q["datetime"][0].split("/")]) if "datetime" in q else (None, None)
            fit = [(i, c) for i, c in items if c in q.get("collections", [c]) and not ((t := catalogue.id_time(i)) and ((first and t < first) or (last and t > last)))]
            at = int(q.get("page", ["0"])[0])
            page = {"features": [{"id": i, "collection": c, "assets": {"x-bands-10m.tif": {"href": f"u/{i}"}}} for i, c in fit[at : at + 2]], "links": []}
            if at + 2 < len(fit):
                path = self.path.split("&page=")[0].split("?page=")[0]
                page["links"].append({"rel": "next", "href": path + ("&" if "?" in path else "?") + f"page={at + 2}"})
            body = json.dumps(page).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/search", asked, items
    server.shutdown()


def test_catalogue_over_http(spark, served):
    url, asked, _ = served
    every = catalogue.scene_catalogue(spark, url)
    assert sorted(r.scene_id for r in every.collect()) == sorted(i for i, _ in ITEMS)
    row = every.where("scene_id = '2018-04-30t100000'").first()
    assert row.assets["x-bands-10m.tif"].href == "u/2018-04-30t100000" and row.scene_ts == T(2018, 4, 30, 10)
    asked.clear()
    some = catalogue.scene_catalogue(spark, url, collection="c", start="2018-05-01", end="2018-06-30")
    assert sorted(r.scene_id for r in some.where("scene_ts is not null").collect()) == ["2018-05-01T000000", "2018-05-31t235959", "2018-06-02t100000"]
    assert {q["datetime"][0] for q in asked} == {"2018-05-01T00:00:00Z/2018-05-31T23:59:59Z", "2018-06-01T00:00:00Z/2018-06-30T23:59:59Z"}
    asked.clear()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    got = catalogue.scene_catalogue(spark, url).where("scene_ts >= timestamp '2018-05-01' and scene_ts < timestamp '2018-06-01' and collection = 'c'")
    assert sorted(r.scene_id for r in got.collect()) == ["2018-05-01T000000", "2018-05-31t235959"]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert all("datetime" in q and q["collections"] == ["c"] for q in asked)


def test_catalogue_in_saved_pages(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"features": [{"id": "2018-04-30t100000", "assets": {}}], "links": [{"rel": "next", "href": "2.json"}]}))
    (tmp_path / "2.json").write_text(json.dumps({"features": [{"id": "2019-04-30t100000", "collection": "c"}]}))
    got = catalogue.scene_catalogue(spark, f"file://{tmp_path}/1.json")
    assert sorted(r.scene_id for r in got.collect()) == ["2018-04-30t100000", "2019-04-30t100000"]
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(json.dumps({"features": [{"id": i, "collection": c, "assets": {}}]}) for i, c in ITEMS))
    assert files.read_catalogue(spark, str(lines), lines=True).count() == len(ITEMS)


def test_catalogue_as_stream_sends_each_scene_once(spark, served, tmp_path):
    url, _, items = served
    out = str(tmp_path / "out")
    for _ in range(2):
        stream = catalogue.scene_catalogue(spark, url, stream=True).select("scene_id", "scene_ts")
        season_stream.drain(stream, lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "c"), "append")
        items.append(("2017-01-01t000000", "c"))  # a late one
    got = [r.scene_id for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted([*(i for i, _ in ITEMS), "2017-01-01t000000"])
