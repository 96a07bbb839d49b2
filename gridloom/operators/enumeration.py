"""Products of post images with the history that each needs, set-based: passes times look-back windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.joins import window_join
from gridloom.operators.relational import ranked


@dataclass(frozen=True)
class Lookback:
    """A window of history: it ends `days` before the product's first post image, is `span` days long, and gives `most` images a burst."""

    days: int
    span: int
    most: int


def multi_window(deltas: int, count: int, span: int, most: int) -> list[Lookback]:
    """Windows that end 1, 2, .. count times `deltas` days back."""
    return [Lookback(deltas * k, span, most) for k in range(1, count + 1)]


PRODUCT = ("mgrs_tile_id", "acq_group_id", "pass_id")


def enumerate_products(acquisitions: DataFrame, windows: Sequence[Lookback], min_pre: int = 1, both_ways: bool = True) -> DataFrame:
    """Rows of all products: opera_id, the product's keys, category post or pre.

    acquisitions: opera_id, jpl_burst_id, polarizations, acq_dt and the keys of PRODUCT. A pre image belongs to a
    product if its burst and polarizations occur among the product's post images and its time lies in a window.
    Bursts with fewer than min_pre images go; with both_ways their post rows go as well.
    """
    posts = acquisitions.select("opera_id", "jpl_burst_id", "polarizations", "acq_dt", *PRODUCT)
    first = posts.groupBy(*PRODUCT).agg(F.min("acq_dt").alias("post_min"))
    wanted = posts.select(*PRODUCT, "jpl_burst_id", "polarizations").distinct().join(first, list(PRODUCT))
    history = acquisitions.select("mgrs_tile_id", "acq_group_id", "jpl_burst_id", "polarizations", F.col("opera_id").alias("pre_id"), F.col("acq_dt").alias("pre_dt"))
    keys = ["mgrs_tile_id", "acq_group_id", "jpl_burst_id", "polarizations"]
    # all windows in one join: a row a product, burst and window
    spans = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w.days).alias("near"), F.lit(w.days + w.span).alias("far"), F.lit(w.most).alias("most")) for k, w in enumerate(windows)])
    asked = wanted.withColumn("w", F.explode(spans)).select(*wanted.columns, "w.*")
    found = window_join(asked, history, keys, "post_min", "pre_dt", F.col("near"), F.col("far"))
    latest = ranked(found, [*PRODUCT, "jpl_burst_id", "k"], [F.col("pre_dt").desc(), F.col("pre_id")], "place").where(F.col("place") <= F.col("most"))
    pre = latest.select(*PRODUCT, "jpl_burst_id", F.col("pre_id").alias("opera_id"))
    pre = pre.distinct()
    enough = pre.groupBy(*PRODUCT, "jpl_burst_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_pre).select(*PRODUCT, "jpl_burst_id")
    on = [*PRODUCT, "jpl_burst_id"]
    post_rows = posts.join(enough, on, "left_semi") if both_ways else posts.join(enough.select(*PRODUCT).distinct(), list(PRODUCT), "left_semi")
    return post_rows.select(*on, "opera_id", F.lit("post").alias("category")).unionByName(pre.join(enough, on, "left_semi").select(*on, "opera_id", F.lit("pre").alias("category")))
