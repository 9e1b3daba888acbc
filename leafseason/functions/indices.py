"""The five vegetation indices as column expressions.

single rounds every step to 32 bits, as arrays of that type would; otherwise all is done in double precision.
infinities keeps the sign of a division by zero, which the resetting fold needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafseason.functions.arithmetic import quotient


def _step(value: Column, single: bool) -> Column:
    return value.cast("float") if single else value


def _number(value: float, single: bool) -> Column:
    return F.lit(value).cast("float" if single else "double")


def normalized_difference(a: Column, b: Column, single: bool = False, infinities: bool = False) -> Column:
    return _step(quotient(_step(a - b, single), _step(a + b, single), infinities), single)


def ndvi(nir: Column, red: Column, **how: bool) -> Column:
    return normalized_difference(nir, red, **how)


def ndmi(nir: Column, swir: Column, **how: bool) -> Column:
    return normalized_difference(nir, swir, **how)


def cci(green: Column, red: Column, **how: bool) -> Column:
    return normalized_difference(green, red, **how)


def evi(nir: Column, red: Column, blue: Column, single: bool = False, infinities: bool = False) -> Column:
    """Enhanced vegetation index of digital numbers as they are; no reflectance scaling is applied. Zero has no sign."""
    n = lambda v: _number(v, single)
    below = _step(_step(_step(nir + _step(n(6) * red, single), single) - _step(n(7.5) * blue, single), single) + n(1), single)
    value = _step(n(2.5) * _step(quotient(_step(nir - red, single), below, infinities), single), single)
    return F.when(value == 0, n(0)).otherwise(value)


def cire(upper: Column, rededge: Column, single: bool = False, infinities: bool = False) -> Column:
    """Red-edge chlorophyll index; NIR stands in for the upper band."""
    return _step(_step(quotient(upper, rededge, infinities), single) - _number(1, single), single)


def with_indices(obs: DataFrame, single: bool = False, infinities: bool = False) -> DataFrame:
    """obs with the columns NDVI, EVI, NDMI, CIRE and CCI from its six band columns."""
    band = {b: (F.col(b).cast("float") if single else F.col(b)) for b in ("red", "green", "blue", "nir", "swir", "rededge")}
    how = {"single": single, "infinities": infinities}
    return obs.withColumns(
        {
            "NDVI": ndvi(band["nir"], band["red"], **how),
            "EVI": evi(band["nir"], band["red"], band["blue"], **how),
            "NDMI": ndmi(band["nir"], band["swir"], **how),
            "CIRE": cire(band["nir"], band["rededge"], **how),
            "CCI": cci(band["green"], band["red"], **how),
        }
    )
