"""Column expressions against numpy in 32 bits."""

import numpy as np
from leafseason.functions.arithmetic import finite, nan_to_null, null_to_sentinel, quotient, sentinel_to_null
from leafseason.functions.indices import with_indices
from leafseason.schema import INDICES
from pyspark.sql import functions as F

BANDS = ["red", "green", "blue", "nir", "swir", "rededge"]


def test_indices_are_bit_equal_to_single_precision(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (4000, 6)).astype(np.float32)
    x[:2000] = rng.integers(0, 10_000, (2000, 6))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, " + ", ".join(f"{b} float" for b in BANDS))
    got = with_indices(df, single=True, infinities=True).orderBy("i").select(*INDICES).toPandas().to_numpy(np.float32)
    r, g, b, n, s, e = x.T
    f = np.float32
    with np.errstate(all="ignore"):
        want = np.stack([(n - r) / (n + r), f(2.5) * ((n - r) / (n + f(6) * r - f(7.5) * b + f(1))), (n - s) / (n + s), n / e - f(1), (g - r) / (g + r)], axis=1)
    assert np.array_equal(got + f(0), want + f(0), equal_nan=True)


def test_zero_divisors(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 1.0)], "a double, b double")
    got = rows.select(quotient(F.col("a"), F.col("b")).alias("n"), quotient(F.col("a"), F.col("b"), True).alias("s")).collect()
    assert [r.n for r in got] == [None, None, None, 1.5, None]
    assert [r.s for r in got] == [float("inf"), -float("inf"), None, 1.5, None]


def test_missing_values(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (255.0,), (None,)], "v double")
    got = rows.select(nan_to_null(F.col("v")), finite(F.col("v")), sentinel_to_null(F.col("v"), 255), null_to_sentinel(F.col("v"), -9999)).collect()
    assert [r[0] for r in got] == [None, float("inf"), 255, None]
    assert [r[1] for r in got] == [None, None, 255, None]
    assert got[2][2] is None and got[3][3] == -9999
