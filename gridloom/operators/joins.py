"""Joins with a shape of their own: time windows behind equal keys, rectangles over grid cells, lattices, siblings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.relational import top_n


def semi_on_keys(df: DataFrame, keys_of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of df whose key occurs in keys_of."""
    return df.join(keys_of.select(*keys), list(keys), "left_semi")


def window_join(post: DataFrame, history: DataFrame, keys: Sequence[str], anchor: str, time: str, back_from: int | Column, back_to: int | Column, bucket_days: int = 8) -> DataFrame:
    """History rows with anchor - back_to <= time < anchor - back_from days, for equal keys. The bounds may be columns of post.

    The interval turns into equal buckets of days, so that a key with a long history is dealt over many partitions and
    only rows of neighbouring days meet; the exact bounds are a filter behind the join.
    """
    back_from, back_to = (F.lit(b) if isinstance(b, int) else b for b in (back_from, back_to))
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    day = lambda c: F.floor(F.timestamp_diff("SECOND", epoch, c) / 86400)
    first = F.floor((day(F.col(anchor)) - back_to) / bucket_days)
    last = F.floor((day(F.col(anchor)) - back_from) / bucket_days)
    left = post.withColumn("_bucket", F.explode(F.sequence(first, last)))
    right = history.withColumn("_bucket", F.floor(day(F.col(time)) / bucket_days))
    back = lambda n: F.timestamp_add("DAY", -n, F.col(anchor))
    return left.join(right, [*keys, "_bucket"]).where((F.col(time) >= back(back_to)) & (F.col(time) < back(back_from))).drop("_bucket")


def window_stats(post: DataFrame, history: DataFrame, keys: Sequence[str], anchor: str, time: str, back_from: int, back_to: int, by: Sequence[str], bucket_hours: int = 6) -> DataFrame:
    """What window_join's pairs say of each `by` of post, without making them: n, the history rows of the window, and last, the
    latest of their times. Rows without history go.

    Every post row asks at the two ends of its window how many history rows lie before. Running counts answer, within a key
    and a few hours; a row a key and bucket tells what came before the bucket. So the work grows with the rows, not with pairs.
    """
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    back = lambda n: F.timestamp_add("DAY", F.lit(-n), F.col(anchor))
    ends = F.array(F.struct(back(back_from).alias("_at"), F.lit(1).alias("_sign")), F.struct(back(back_to).alias("_at"), F.lit(-1).alias("_sign")))
    asks = post.where(known).select(*keys, *by, back(back_to).alias("_low"), F.explode(ends).alias("_e")).select(*keys, *by, "_low", "_e.*")
    marks = asks.unionByName(history.where(known).select(*keys, F.col(time).alias("_at"), F.lit(0).alias("_sign")), allowMissingColumns=True).where("_at IS NOT NULL")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("_at"))
    marks = marks.withColumn("_bucket", F.floor(seconds / (3600 * bucket_hours)))
    there = F.col("_sign") == 0
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = marks.groupBy(*keys, "_bucket").agg(F.count_if(there).alias("_n"), F.max(F.when(there, F.col("_at"))).alias("_t"))
    buckets = buckets.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.max("_t").over(before).alias("_t0"))
    # at one time those that ask come first, as the window's end is open
    run = Window.partitionBy(*keys, "_bucket").orderBy("_at", there.cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    told = marks.withColumn("_n1", F.count_if(there).over(run)).withColumn("_t1", F.max(F.when(there, F.col("_at"))).over(run)).where(~there)
    told = told.join(buckets, [*keys, "_bucket"])
    latest = F.when(F.col("_sign") > 0, F.coalesce("_t1", "_t0"))
    out = told.groupBy(*by).agg(F.sum(F.col("_sign") * (F.col("_n0") + F.col("_n1"))).alias("n"), F.max(F.when(latest >= F.col("_low"), latest)).alias("last"))
    return out.where("n > 0")


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed rectangles with a point in common."""
    return (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])


def rectangles_by_cell(rects: DataFrame, size: float) -> DataFrame:
    """A row for each grid cell that a rectangle (xmin, ymin, xmax, ymax) touches: gives spatial joins an equal key."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    return rects.withColumn("_cx", F.explode(span("xmin", "xmax"))).withColumn("_cy", F.explode(span("ymin", "ymax")))


def _cells_of(rects: DataFrame, size: tuple[float, float]) -> DataFrame:
    """A row for each grid cell that a half-open rectangle shares points with."""
    span = lambda lo, hi, s: F.sequence(F.floor(F.col(lo) / s), F.greatest(F.floor(F.col(lo) / s), F.ceil(F.col(hi) / s) - 1))
    some = rects.where("xmin < xmax AND ymin < ymax")
    return some.withColumn("_cx", F.explode(span("xmin", "xmax", size[0]))).withColumn("_cy", F.explode(span("ymin", "ymax", size[1])))


def _sizes(size: float | tuple[float, float]) -> tuple[float, float]:
    """Sizes along both axes, as powers of two not over those given: division by them is exact, so cells have sharp edges."""
    return tuple(2.0 ** math.floor(math.log2(s)) for s in (size if isinstance(size, tuple) else (size, size)))


def _inside(x: str, y: str) -> Column:
    return (F.col(x) >= F.col("xmin")) & (F.col(x) < F.col("xmax")) & (F.col(y) >= F.col("ymin")) & (F.col(y) < F.col("ymax"))


def points_in_rectangles(points: DataFrame, rects: DataFrame, size: float | tuple[float, float], x: str = "x", y: str = "y") -> DataFrame:
    """Half-open containment (xmin <= x < xmax) of points in rectangles, by the cells of a grid, whose sizes should be a third of
    the rectangles' or so on each axis.

    The join is never a broadcast, as a rectangle has a row a cell; pairs leave as they are found, so memory does not grow
    with a cell's pairs.
    """
    sx, sy = _sizes(size)
    p = points.withColumn("_cx", F.floor(F.col(x) / sx)).withColumn("_cy", F.floor(F.col(y) / sy))
    return p.join(_cells_of(rects, (sx, sy)).hint("merge"), ["_cx", "_cy"]).where(_inside(x, y)).drop("_cx", "_cy")


def first_rectangle(points: DataFrame, rects: DataFrame, size: float | tuple[float, float], by: Sequence[str], order: str, x: str = "x", y: str = "y") -> DataFrame:
    """For each `by` of points the least order among the rectangles that hold it, without all pairs: in a cell, the first
    rectangle that covers it whole bounds the search, so only those before it that cover it in part are tried."""
    sx, sy = _sizes(size)
    parts = _cells_of(rects, (sx, sy))
    whole = (F.col("xmin") <= F.col("_cx") * sx) & (F.col("xmax") >= (F.col("_cx") + 1) * sx) & (F.col("ymin") <= F.col("_cy") * sy) & (F.col("ymax") >= (F.col("_cy") + 1) * sy)
    parts = parts.where(F.col(order).isNotNull()).withColumn("_whole", whole)
    bound = parts.where("_whole").groupBy("_cx", "_cy").agg(F.min(order).alias("_first"))
    parts = parts.join(bound, ["_cx", "_cy"], "left").where(F.col("_first").isNull() | (F.col(order) < F.col("_first")) | ((F.col(order) == F.col("_first")) & F.col("_whole")))
    p = points.withColumn("_cx", F.floor(F.col(x) / sx)).withColumn("_cy", F.floor(F.col(y) / sy))
    return p.join(parts.drop("_whole", "_first").hint("merge"), ["_cx", "_cy"]).where(_inside(x, y)).groupBy(*by).agg(F.min(order).alias(order))


def lattice_index(value: Column, origin: float, step: float) -> Column:
    """Nearest lattice place, as whole number; only within 0.49 of a step."""
    at = (value - origin) / step
    return F.when(F.abs(at - F.round(at)) <= 0.49, F.round(at).cast("long"))


def siblings(df: DataFrame, group: Sequence[str], kind: str, order: Sequence[Column]) -> DataFrame:
    """For each (group, kind) its representative, and the representatives of the group's other kinds."""
    one = top_n(df, [*group, kind], order)
    a, b = one.alias("a"), one.alias("b")
    cond = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group]
    return a.join(b, cond).where(F.col(f"a.{kind}") != F.col(f"b.{kind}")).select(*[F.col(f"a.{c}") for c in df.columns], *[F.col(f"b.{c}").alias(f"sibling_{c}") for c in df.columns if c not in group])


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's most frequent value; the smaller one on a tie. NULL values do not vote."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).count()
    return counts.groupBy(key).agg(F.max_by(value, F.struct("count", F.lit(0))).alias("_any"), F.max("count").alias("_n")).join(counts, key).where(F.col("count") == F.col("_n")).groupBy(key).agg(F.min(value).alias(value))
