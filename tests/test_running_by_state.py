import datetime as dt

import numpy as np
from leafseason.streaming import season_stream


def test_a_key_in_many_frames_is_folded_in_order(spark, tmp_path, monkeypatch):
    """A key's rows reach Python in frames of three, which are not sorted among each other."""
    monkeypatch.setattr(season_stream, "FRAME_ROWS", 7)
    rng = np.random.default_rng(4)
    pool = [None, float("nan"), float("inf"), float("-inf"), *map(float, range(40))]
    rows = [(int(k), dt.datetime(2020, 1, 1) + dt.timedelta(hours=int(t)), pool[rng.integers(len(pool))]) for t, k in enumerate(rng.integers(0, 3, 120))]
    schema, source, out = "k long, ts timestamp, v double", str(tmp_path / "in"), str(tmp_path / "out")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        for part in (rows[:70], rows[70:]):
            spark.createDataFrame([part[i] for i in rng.permutation(len(part))], schema).coalesce(1).write.mode("append").parquet(source)
            made = season_stream.running_by_state(season_stream.read_stream(spark, source, schema), "k", "ts", "v")
            season_stream.drain(made, lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "c"), "append")
    finally:
        spark.conf.set(name, before)
    want, ends = [], {}
    for k, ts, v in rows:
        if v is not None and np.isfinite(v):
            low, high = ends.get(k, (v, v))
            ends[k] = min(low, v), max(high, v)
        want.append((k, ts, *ends.get(k, (None, None))))
    got = [tuple(r) for r in spark.read.parquet(out).orderBy("ts").collect()]
    assert got == want
