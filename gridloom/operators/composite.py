"""Temporal composites and mosaics over cells, one grouped pass a step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.radar import positive, ratio, rvi, to_db
from gridloom.operators.relational import first_valid


def trimmed_mean(v: Column, fraction: float = 0.15) -> Column:
    """Mean after int(fraction * n) values go at each end of all n, missing ones sorted last; NULL if a missing one survives."""
    n = F.count(F.lit(1))
    cut = F.floor(n * fraction).cast("int")
    ordered = F.array_sort(F.collect_list(v))  # holds the present ones; the missing n - size would come after them
    kept = F.slice(ordered, cut + 1, (n - 2 * cut).cast("int"))
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)
    return F.when((n - F.count(v) <= cut) & (n - 2 * cut > 0), total / (n - 2 * cut))


def reducer(v: Column, method: str = "median", trim: float = 0.15) -> Column:
    """median, min, mean or trimmed_mean, with or without nan before it; missing values are skipped but by the last."""
    name = method.removeprefix("nan")
    if name == "min":
        return F.min(v)
    if name == "mean":
        return F.avg(v)
    if name == "trimmed_mean":
        return trimmed_mean(v, trim)
    if name == "median":
        return F.median(v)
    raise ValueError(f"unknown composite method: {method}")


def composite(cells: DataFrame, keys: Sequence[str], method: str = "median", trim: float = 0.15) -> DataFrame:
    """VV and VH of each key over its scenes, with n_obs, the scenes whose VV counts."""
    vv, vh = positive(F.col("vv")), positive(F.col("vh"))
    return cells.groupBy(*keys).agg(reducer(vv, method, trim).alias("vv"), reducer(vh, method, trim).alias("vh"), F.count(vv).alias("n_obs"))


def track_order(per_track: DataFrame, keys: Sequence[str] = ("month",), track: str = "track") -> DataFrame:
    """Tracks by covered cells, most first; the lower track on a tie.

    The last two order keys never decide, as tracks differ. They keep all columns of per_track in use, so that this
    branch equals the one it is joined with and Spark shares the shuffle instead of composing twice.
    """
    covered = per_track.groupBy(*keys, track).agg(F.count("vv").alias("covered"), F.count("vh").alias("covered_vh"), F.sum("n_obs").alias("observations"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("covered").desc(), F.col(track), "covered_vh", "observations"))
    return covered.withColumn("priority", rank)


def derived_bands(df: DataFrame, digits: int | None = None) -> DataFrame:
    """vv_db, vh_db, ratio and rvi beside the rest."""
    vv, vh = F.col("vv"), F.col("vh")
    bands = {"vv_db": to_db(vv), "vh_db": to_db(vh), "ratio": ratio(vv, vh), "rvi": rvi(vv, vh)}
    return df.withColumns({k: v if digits is None else F.round(v, digits) for k, v in bands.items()})


def priority_mosaic(cells: DataFrame, method: str = "median") -> DataFrame:
    """Month by month: composite each track, order the tracks, fill each cell from the first track with a valid VV.

    VV, VH and n_obs of a cell come from one track. One shuffle by (month, cell, track); the second by (month, cell)
    moves a row a cell and track; the order of tracks is a table of months times tracks.
    """
    per_track = composite(cells, ["month", "row", "col", "track"], method)
    order = track_order(per_track).select("month", "track", "priority")
    joined = per_track.join(order, ["month", "track"])
    best = first_valid(F.struct("vv", "vh", "n_obs", "track"), F.col("priority"), F.col("vv").isNotNull())
    return joined.groupBy("month", "row", "col").agg(best.alias("b")).where("b IS NOT NULL").select("month", "row", "col", "b.*")


def first_valid_mosaic(cells: DataFrame, keys: Sequence[str], order: Column, value: str = "vv") -> DataFrame:
    """The first valid value of a cell in list order."""
    v = F.col(value)
    return cells.groupBy(*keys).agg(first_valid(v, order, v.isNotNull()).alias(value))
