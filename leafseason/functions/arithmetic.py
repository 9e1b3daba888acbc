"""Arithmetic with a defined result for every zero divisor, NaN and infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def quotient(num: Column, den: Column, infinities: bool = False) -> Column:
    """num / den in double precision. A zero divisor gives NULL, or with infinities that of the numerator's sign (0/0: NULL)."""
    if not infinities:
        return F.try_divide(num.cast("double"), den.cast("double"))
    return F.when(den != 0, num.cast("double") / den.cast("double")).when(num > 0, F.lit(INF)).when(num < 0, F.lit(-INF))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    """value, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != INF), value)


def sentinel_to_null(value: Column, sentinel: float) -> Column:
    return F.nullif(value, F.lit(sentinel))


def null_to_sentinel(value: Column, sentinel: float) -> Column:
    return F.coalesce(value, F.lit(sentinel))
