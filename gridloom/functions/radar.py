"""Column functions of radar backscatter: missing values, decibels, ratios, scaling, quantising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the on-disk mark of missing pixels.
NODATA = -9999.0


def finite(v: Column, nodata: float | None = None) -> Column:
    """NaN, infinities, the nodata mark and the profile's own nodata become NULL, so aggregates skip them."""
    ok = ~F.isnan(v) & (F.abs(v) != float("inf")) & (v != NODATA)
    return F.when(ok if nodata is None else ok & (v != nodata), v)


def positive(v: Column) -> Column:
    """The composite reader's rule: only finite values over zero count."""
    return F.when(~F.isnan(v) & (v > 0) & (v != float("inf")), v)


def to_db(v: Column) -> Column:
    return F.when(v > 0, 10 * F.log10(v))


def from_db(v: Column) -> Column:
    return F.pow(F.lit(10.0), v / 10)


def ratio(vv: Column, vh: Column) -> Column:
    return F.when(vv > 0, vh / vv)


def rvi(vv: Column, vh: Column) -> Column:
    """Radar vegetation index, from 0 to 4."""
    return F.when(vv + vh > 0, 4 * vh / (vv + vh))


def legacy_ratio(vv: Column, vh: Column, eps: float = 1e-10) -> Column:
    """The retired workflow's ratio: masked where VH is not over eps, eps in the denominator."""
    return F.when(vh > eps, vh / (vv + eps))


def legacy_rvi(vv: Column, vh: Column, eps: float = 1e-10) -> Column:
    return F.when(vh > eps, 4 * vh / (vv + vh + eps))


def to_byte(v: Column, low: float, high: float) -> Column:
    """Stretch low..high to 0..255 and cut off the fraction; missing is 0."""
    x = F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.floor(x * 255), F.lit(0)).cast("int")


def fill_nodata(v: Column) -> Column:
    return F.coalesce(v, F.lit(NODATA))


def quantise(v: Column, low: float, high: float, levels: int, missing: int) -> Column:
    """Grey levels 0 .. levels - 1 over low..high; NULL gets its own level."""
    x = F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.coalesce(F.floor(x * (levels - 1)), F.lit(missing)).cast("int")
