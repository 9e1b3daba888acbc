import datetime as dt

from leafseason.plans import queries
from leafseason.streaming import season_stream

SCHEMA = "k long, ts timestamp"


def test_late_rows_are_taken_and_no_key_is_sent_twice(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    for rows in ([(1, day(100))], [(2, day(300))], [(1, day(301)), (3, day(0))], [(4, day(1)), (2, day(500))]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        firsts = season_stream.first_seen(season_stream.read_stream(spark, source, SCHEMA), "k")
        season_stream.drain(firsts, lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "c"), "append")
    got = sorted((r.k, r.ts) for r in spark.read.parquet(out).collect())
    assert got == [(1, day(100)), (2, day(300)), (3, day(0)), (4, day(1))]


def test_the_query_runs_through_first_seen(spark, monkeypatch):
    asked, own = [], season_stream.first_seen
    monkeypatch.setattr(season_stream, "first_seen", lambda stream, *key: asked.append(key) or own(stream, *key))
    folder = "/root/testdata/sf0.001"
    got = queries.stream_new_scenes(spark, folder)
    want = spark.read.parquet(f"{folder}/events.parquet").groupBy("user_id").agg({"ts": "min"}).toDF("user_id", "first_ts")
    assert asked and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
