"""Every query of the season engine against its SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from leafseason.plans.products import ORACLE_SQL, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"


def plain(frame: pd.DataFrame) -> list:
    rows = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    show = lambda v: "~" if v is None else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(show, r)) for r in rows[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    base = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events", "embeddings", "pages"):
        base.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), base.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
