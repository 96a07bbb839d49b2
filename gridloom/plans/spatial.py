"""Queries of the array operators, on 8 x 8 blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import radar
from gridloom.operators import raster
from gridloom.operators.relational import keyed_hash, tie_broken, top_n
from gridloom.plans.bind import cells, chunks, placed_cells, query, table


def _quantised(spark, sf):
    v = F.col("v").cast("double")
    return chunks(spark, sf).select("block_id", "row", "col", radar.quantise(v, -0.2, 0.2, 8, 8).alias("q"))


QUANT = "(SELECT block_id, row, col, CAST(coalesce(floor(least(greatest((CAST(v AS DOUBLE) + 0.2) / 0.4, 0), 1) * 7), 8) AS INTEGER) AS q FROM {D})"


@query("arr1_spatial_blocks", "SELECT CAST(floor(row / 3) AS BIGINT) AS by, CAST(floor(col / 4) AS BIGINT) AS bx, count(*) AS n FROM {C} GROUP BY ALL")
def arr1(spark, sf):
    return cells(spark, sf).groupBy(F.floor(F.col("row") / 3).alias("by"), F.floor(F.col("col") / 4).alias("bx")).agg(F.count("*").alias("n"))


@query("arr3_5_shifted_mosaic", "SELECT month, row + 2 * track AS mrow, col - track + 3 AS mcol, arg_min(vh, scene_id * 10 + seq) FILTER (vh IS NOT NULL) AS vh FROM {C} GROUP BY ALL")
def arr3_5(spark, sf):
    """Scenes on aligned lattices move by whole offsets, then the first valid one fills a master cell."""
    from gridloom.operators.composite import first_valid_mosaic

    c = placed_cells(spark, sf).withColumn("mrow", F.col("row") + 2 * F.col("track")).withColumn("mcol", F.col("col") - F.col("track") + 3)
    return first_valid_mosaic(c, ["month", "mrow", "mcol"], tie_broken(F.col("scene_id") * 10 + F.col("seq"), F.col("place")), "vh")


@query("arr4_nearest_resample", "SELECT d.block_id, t.r AS row, t.c AS col, d.v FROM {D} d JOIN (SELECT r, c, CAST(floor(r * 2 / 3) AS BIGINT) AS sr, CAST(floor(c * 2 / 3) AS BIGINT) AS sc FROM (SELECT unnest(range(0, 12)) AS r) CROSS JOIN (SELECT unnest(range(0, 12)) AS c)) t ON d.row = t.sr AND d.col = t.sc")
def arr4_nearest(spark, sf):
    """Nearest neighbour from 8 x 8 to 12 x 12: each source cell knows the target rows and columns that it serves."""
    targets = lambda c: F.filter(F.array(*map(F.lit, range(12))), lambda t: F.floor(t * 2 / 3) == F.col(c))
    out = chunks(spark, sf).withColumn("r", F.explode(targets("row"))).withColumn("c", F.explode(targets("col")))
    return out.select("block_id", F.col("r").cast("long").alias("row"), F.col("c").cast("long").alias("col"), "v")


BILINEAR = """WITH ax AS (SELECT t, CAST(least(greatest(floor(y), 0), 7) AS BIGINT) AS a, least(greatest(y - least(greatest(floor(y), 0), 7), 0), 1) AS f FROM (SELECT t, (t + 0.5) / 3 - 0.5 AS y FROM (SELECT unnest(range(0, 24)) AS t))),
    w AS (SELECT t, a AS s, 1 - f AS k FROM ax UNION ALL SELECT t, least(a + 1, 7), f FROM ax)
    SELECT block_id, r.t AS row, c.t AS col, CASE WHEN sum(r.k * c.k) FILTER (v IS NOT NULL) > 0 THEN round(sum(CAST(v AS DOUBLE) * r.k * c.k) / sum(r.k * c.k) FILTER (v IS NOT NULL), 6) END AS v
    FROM {D} d JOIN w r ON d.row = r.s JOIN w c ON d.col = c.s GROUP BY block_id, r.t, c.t"""


@query("arr4_bilinear_resample", BILINEAR)
def arr4_bilinear(spark, sf):
    d = chunks(spark, sf).withColumn("v", F.col("v").cast("double"))

    def run(rows, starts):
        for blocks, a, *_ in raster.stacks(rows, starts, "v"):
            b = raster.bilinear(a, 3)
            _, r, c = np.indices(b.shape)
            frame = rows.iloc[np.repeat(starts[blocks], b[0].size)][["block_id"]].reset_index(drop=True)
            yield frame.assign(row=r.ravel(), col=c.ravel(), v=b.ravel())

    out = raster.in_blocks(d.select("block_id", "row", "col", "v"), ["block_id"], run, "block_id long, row long, col long, v double")
    return out.withColumn("v", F.round("v", 6))


@query("arr6_priority_window", "SELECT row, col, arg_min(vh, track * 1000000 + scene_id * 10 + seq) FILTER (vh IS NOT NULL) AS vh, arg_min(track, track * 1000000 + scene_id * 10 + seq) FILTER (vh IS NOT NULL) AS track FROM {C} GROUP BY ALL")
def arr6(spark, sf):
    order = tie_broken(F.col("track") * 1_000_000 + F.col("scene_id") * 10 + F.col("seq"), F.col("place"))
    best = F.min_by(F.struct("vh", "track"), F.when(F.col("vh").isNotNull(), order))
    return placed_cells(spark, sf).groupBy("row", "col").agg(best.alias("b")).select("row", "col", "b.*")


@query("arr8_scene_mosaics", "SELECT track, month, row, col, arg_min(vv, scene_id * 10 + seq) AS vv, count(*) AS n FROM {C} WHERE vv > 0.1 GROUP BY ALL")
def arr8(spark, sf):
    c = placed_cells(spark, sf).where("vv > 0.1")
    return c.groupBy("track", "month", "row", "col").agg(F.min_by("vv", tie_broken(F.col("scene_id") * 10 + F.col("seq"), F.col("place"))).alias("vv"), F.count("*").alias("n"))


HOLES = """WITH RECURSIVE c AS (SELECT block_id, row, col, v IS NOT NULL AS ok FROM {D}),
    o AS (SELECT block_id, row, col FROM c WHERE NOT ok AND (row IN (0, 7) OR col IN (0, 7)) UNION SELECT c.block_id, c.row, c.col FROM o JOIN c ON c.block_id = o.block_id AND NOT c.ok AND abs(c.row - o.row) + abs(c.col - o.col) = 1)
    SELECT c.block_id, count(*) FILTER (NOT ok AND o.row IS NULL) AS hole_px, count(*) AS n_px FROM c LEFT JOIN o ON o.block_id = c.block_id AND o.row = c.row AND o.col = c.col GROUP BY ALL"""


@query("arr10_interior_holes", HOLES)
def arr10(spark, sf):
    return raster.hole_fraction(chunks(spark, sf), ["block_id"], "v")


STRIPS = "SELECT s_nationkey AS tile, s_suppkey, least(greatest(s_acctbal / 10000, 0), 1) AS lo, least(greatest(s_acctbal / 10000 + 0.2, 0), 1) AS hi FROM supplier"
COVERED = "SELECT tile, sum(greatest(0, hi - greatest(lo, coalesce(before, -1)))) AS a FROM (SELECT tile, lo, hi, max(hi) OVER (PARTITION BY tile ORDER BY lo, hi, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({})) GROUP BY tile"


@query("arr11_hole_estimate", f"SELECT u.tile, round(u.a - coalesce(p.a, 0), 9) AS hole FROM ({COVERED.format(STRIPS)}) u LEFT JOIN ({COVERED.format(STRIPS + ' WHERE s_suppkey % 3 <> 0')}) p USING (tile)")
def arr11(spark, sf):
    """Area of each tile that missing strips leave open: the union of all strips less that of the present ones."""
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_acctbal") / 10000).alias("y"))

    def run(key, pdf):
        import pandas as pd

        r = np.stack([np.zeros(len(pdf)), pdf.y.clip(0, 1), np.ones(len(pdf)), (pdf.y + 0.2).clip(0, 1)], 1)
        present = r[pdf.s_suppkey.to_numpy() % 3 != 0]
        return pd.DataFrame([(key[0], round(raster.union_area(r) - raster.union_area(present), 9))], columns=["tile", "hole"])

    return s.groupBy("s_nationkey").applyInPandas(run, "tile int, hole double")


@query("arr12_missing_interior_bursts", "WITH f AS (SELECT p_size AS g, p_partkey % 30 AS b FROM part GROUP BY ALL), p AS (SELECT p_size AS g, p_partkey % 30 AS b FROM part WHERE p_partkey % 7 = 0 GROUP BY ALL), e AS (SELECT g, min(b) AS lo, max(b) AS hi FROM p GROUP BY ALL) SELECT f.g, string_agg(CAST(f.b AS VARCHAR), ',' ORDER BY f.b) AS missing FROM f JOIN e USING (g) LEFT JOIN p ON p.g = f.g AND p.b = f.b WHERE p.b IS NULL AND f.b > lo AND f.b < hi GROUP BY ALL")
def arr12(spark, sf):
    p = table(spark, sf, "part").withColumn("b", F.col("p_partkey") % 30).groupBy(F.col("p_size").alias("g"))
    sets = p.agg(F.collect_set("b").alias("foot"), F.collect_set(F.when(F.col("p_partkey") % 7 == 0, F.col("b"))).alias("present"))
    missing = F.filter(F.array_sort(F.array_except("foot", "present")), lambda x: (x > F.array_min("present")) & (x < F.array_max("present")))
    return sets.select("g", F.array_join(missing, ",").alias("missing")).where("missing <> ''")


@query("arr13_burst_coverage", "SELECT track_number, count(DISTINCT burst) AS loaded, 24 AS expected, greatest(0, 24 - count(DISTINCT burst)) AS missing FROM {A} GROUP BY ALL")
def arr13(spark, sf):
    from gridloom.plans.bind import acquisitions

    g = acquisitions(spark, sf).groupBy("track_number").agg(F.count_distinct("burst").alias("loaded"))
    return g.select("track_number", "loaded", F.lit(24).alias("expected"), F.greatest(F.lit(0), 24 - F.col("loaded")).alias("missing"))


@query("arr14_roi_mask", "SELECT block_id, row, col, CASE WHEN 30 * col + 15 BETWEEN 40 AND 170 AND 30 * row + 15 BETWEEN 60 AND 200 THEN v END AS v FROM {D}")
def arr14(spark, sf):
    """Cell centres in the region; the mask comes last, so neighbourhood operators see what lies outside it."""
    x, y = 30 * F.col("col") + 15, 30 * F.col("row") + 15
    return chunks(spark, sf).select("block_id", "row", "col", F.when(x.between(40, 170) & y.between(60, 200), F.col("v")).alias("v"))


@query("arr16_glcm_quantize", f"SELECT * FROM {QUANT}")
def arr16(spark, sf):
    return _quantised(spark, sf)


@query("arr17_glcm_relational", f"""WITH q AS {QUANT}, p AS (SELECT a.block_id, a.row, a.col, CASE WHEN a.q < 8 AND b.q < 8 THEN (a.q - b.q) * (a.q - b.q) END AS d2 FROM q a JOIN q b ON a.block_id = b.block_id AND b.row = a.row AND b.col = least(a.col + 1, 7)),
    w AS (SELECT unnest([-2, -1, 0, 1, 2]) AS k)
    SELECT q.block_id, q.row, q.col, round(avg(d2), 6) AS contrast, round(avg(1.0 / (1 + d2)), 6) AS homogeneity FROM q CROSS JOIN w r CROSS JOIN w c JOIN p ON p.block_id = q.block_id AND p.row = least(greatest(q.row + r.k, 0), 7) AND p.col = least(greatest(q.col + c.k, 0), 7) WHERE q.q < 8 GROUP BY ALL""")
def arr17(spark, sf):
    t = raster.texture_relational(_quantised(spark, sf), ["block_id"], 8, 8, 8)
    return t.select("block_id", "row", "col", F.round("contrast", 6).alias("contrast"), F.round("homogeneity", 6).alias("homogeneity"))


@query("arr15_glcm_texture", f"""WITH q AS {QUANT}, p AS (SELECT a.block_id, a.row, a.col, CASE WHEN a.q < 8 AND b.q < 8 THEN (a.q - b.q) * (a.q - b.q) END AS d2 FROM q a JOIN q b ON a.block_id = b.block_id AND b.row = a.row AND b.col = least(a.col + 1, 7)),
    w AS (SELECT unnest([-2, -1, 0, 1, 2]) AS k)
    SELECT q.block_id, q.row, q.col, round(avg(d2), 6) AS contrast, round(avg(1.0 / (1 + d2)), 6) AS homogeneity FROM q CROSS JOIN w r CROSS JOIN w c JOIN p ON p.block_id = q.block_id AND p.row = least(greatest(q.row + r.k, 0), 7) AND p.col = least(greatest(q.col + c.k, 0), 7) WHERE q.q < 8 GROUP BY ALL""")
def arr15(spark, sf):
    """The numpy kernel on the same blocks; the two forms must agree."""
    def kernel(a):
        return raster.texture(np.nan_to_num(a, nan=8).astype(int), 8, angles=(0,))

    t = raster.per_block(_quantised(spark, sf).withColumn("q", F.col("q").cast("double")), ["block_id"], "q", kernel, raster.METRICS)
    return t.where("contrast IS NOT NULL").select("block_id", "row", "col", F.round("contrast", 6).alias("contrast"), F.round("homogeneity", 6).alias("homogeneity"))


@query("arr15_glcm_all_metrics")
def arr15_all(spark, sf):
    def kernel(a):
        return raster.texture(np.nan_to_num(a, nan=8).astype(int), 8, angles=(0, 90))

    t = raster.per_block(_quantised(spark, sf).withColumn("q", F.col("q").cast("double")), ["block_id"], "q", kernel, raster.METRICS)
    return t.select("block_id", "row", "col", *[F.round(m, 6).alias(f"VV_glcm_{n}") for m, n in zip(raster.METRICS, ("CONTR", "IDM", "ENT", "CORR"), strict=True)])


@query("arr19_halo_mean", "SELECT a.block_id, a.row, a.col, round(avg(CAST(b.v AS DOUBLE)), 5) AS m FROM {D} a JOIN {D} b ON a.block_id = b.block_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 WHERE a.v IS NOT NULL GROUP BY ALL")
def arr19(spark, sf):
    """A 3 x 3 mean by 4 x 4 blocks with a halo of 1: cells go to every block that needs them, each block keeps its own."""
    d = raster.halo_explode(chunks(spark, sf).withColumn("v", F.col("v").cast("double")), 4, 1, 8, 8)

    def mean(a):
        p = np.pad(a, ((0, 0), (1, 1), (1, 1)), constant_values=np.nan)
        near = np.stack([p[:, i : i + a.shape[1], j : j + a.shape[2]] for i in range(3) for j in range(3)])
        n = (~np.isnan(near)).sum(0)
        return np.where(n > 0, np.nansum(near, 0) / np.maximum(n, 1), np.nan)

    d = d.withColumn("own", F.col("own") & F.col("v").isNotNull())
    out = raster.per_cell(d, ["block_id", "by", "bx"], "v", mean, "m", "own")
    return out.select("block_id", "row", "col", F.round("m", 5).alias("m"))


@query("arr20_despeckle")
def arr20(spark, sf):
    d = chunks(spark, sf).withColumn("v", F.col("v").cast("double") + 0.3)
    return raster.per_block(d, ["block_id"], "v", lambda a: {"tv": raster.smooth_tv(a), "nlm": raster.smooth_nlm(a)}, ["tv", "nlm"])


HOLES = """WITH RECURSIVE d AS (SELECT block_id, row, col, CAST(CASE WHEN (row * 5 + col * 3 + block_id) % 7 < 2 THEN NULL ELSE v END AS DOUBLE) AS v FROM {D}),
    outer_ AS (SELECT block_id, row, col FROM d WHERE v IS NULL AND (row IN (0, 7) OR col IN (0, 7)) UNION SELECT d.block_id, d.row, d.col FROM outer_ o JOIN d ON d.block_id = o.block_id AND abs(d.row - o.row) + abs(d.col - o.col) = 1 AND d.v IS NULL),
    near AS (SELECT m.block_id, m.row, m.col, arg_min(g.v, ((m.row - g.row) * (m.row - g.row) + (m.col - g.col) * (m.col - g.col)) * 100 + g.row * 8 + g.col) AS v FROM d m ANTI JOIN outer_ o ON o.block_id = m.block_id AND o.row = m.row AND o.col = m.col JOIN d g ON g.block_id = m.block_id AND g.v IS NOT NULL WHERE m.v IS NULL GROUP BY ALL)
    SELECT block_id, row, col, coalesce(d.v, n.v) AS filled FROM d LEFT JOIN near n USING (block_id, row, col)"""


@query("arr21_nearest_fill", HOLES)
def arr21(spark, sf):
    """Holes inside a block take the nearest valid value; missing parts that reach its border stay missing."""
    gap = F.pmod(F.col("row") * 5 + F.col("col") * 3 + F.col("block_id"), F.lit(7)) < 2
    d = chunks(spark, sf).withColumn("v", F.when(~gap, F.col("v").cast("double")))
    return raster.per_block(d, ["block_id"], "v", lambda a: {"filled": raster.fill_holes(a)}, ["filled"])


@query("arr22_patches", "SELECT block_id, y0, x0, round(sum(CAST(v AS DOUBLE)), 5) AS total, round(count(v) / 16.0, 6) AS valid FROM {D}, (SELECT unnest([0, 2, 4]) AS y0), (SELECT unnest([0, 2, 4]) AS x0) WHERE row >= y0 AND row < y0 + 4 AND col >= x0 AND col < x0 + 4 GROUP BY ALL HAVING count(v) >= 12")
def arr22(spark, sf):
    p = raster.patches(chunks(spark, sf).withColumn("v", F.col("v").cast("double")), ["block_id"], 8, 8, 4, 2).where("valid >= 0.75")
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return p.select("block_id", F.col("y0").alias("y0"), "x0", F.round(total, 5).alias("total"), F.round("valid", 6).alias("valid"))


def _corner(seed):
    """A corner from 0 to 4 by two hexadecimal digits of the hash of seed, block and draw."""
    h = f"sha256('{seed}|' || block_id || '|' || draw)"
    return f"(16 * (instr('0123456789abcdef', substr({h}, 1, 1)) - 1) + instr('0123456789abcdef', substr({h}, 2, 1)) - 1) % 5"


@query("smp1_random_patches", f"SELECT block_id, draw, y0, x0, count(v) AS n_valid, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM (SELECT *, {_corner(1)} AS y0, {_corner(2)} AS x0 FROM {{D}}, (SELECT unnest([0, 1]) AS draw)) WHERE row >= y0 AND row < y0 + 4 AND col >= x0 AND col < x0 + 4 GROUP BY ALL")
def smp1(spark, sf):
    """Random corners from a keyed hash of block and draw: the same on every run and layout."""
    d = chunks(spark, sf).withColumn("v", F.col("v").cast("double"))
    origin = lambda seed: F.conv(F.substring(keyed_hash(["block_id", "draw"], seed), 1, 2), 16, 10).cast("long") % 5
    cells_ = d.withColumn("draw", F.explode(F.array(*map(F.lit, range(2))))).withColumn("y0", origin(1)).withColumn("x0", origin(2))
    inside = (F.col("row") >= F.col("y0")) & (F.col("row") < F.col("y0") + 4) & (F.col("col") >= F.col("x0")) & (F.col("col") < F.col("x0") + 4)
    return cells_.where(inside).groupBy("block_id", "draw", "y0", "x0").agg(F.count("v").alias("n_valid"), F.round(F.avg("v"), 6).alias("mean"))


@query("arr23_normalised_patch", "WITH s AS (SELECT band, avg(CAST(v AS DOUBLE)) AS m, stddev_pop(CAST(v AS DOUBLE)) AS d FROM {D} GROUP BY ALL) SELECT block_id, row, col, round(coalesce((CAST(v AS DOUBLE) - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 0), 4) AS z FROM {D} JOIN s USING (band)")
def arr23(spark, sf):
    d = chunks(spark, sf).withColumn("v", F.col("v").cast("double"))
    s = d.groupBy("band").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
    return d.join(F.broadcast(s), "band").select("block_id", "row", "col", F.round(raster.normalised(F.col("v"), F.col("m"), F.col("d")), 4).alias("z"))


@query("arr24_25_pixel_timeseries", "SELECT t, scene_id, seq, round(10 * log10(vv), 4) AS vv_db, round(10 * log10(vh), 4) AS vh_db FROM {C} WHERE row = 3 AND col = 2 AND vv > 0 AND vh > 0")
def arr24_25(spark, sf):
    c = cells(spark, sf).where("row = 3 AND col = 2 AND vv > 0 AND vh > 0")
    return c.select("t", "scene_id", "seq", F.round(radar.to_db(F.col("vv")), 4).alias("vv_db"), F.round(radar.to_db(F.col("vh")), 4).alias("vh_db"))


@query("arr26_27_track_series", "WITH n AS (SELECT row, col, track, count(*) AS n FROM {C} WHERE vv IS NOT NULL AND vh IS NOT NULL GROUP BY ALL), w AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, track) = 1), s AS (SELECT row, col, track, count(*) AS n_steps, min(t) AS first_t, max(t) AS last_t, string_agg(CAST(vh AS DECIMAL(4, 2)), ',' ORDER BY t, scene_id, seq) AS vh FROM {C} WHERE vv IS NOT NULL AND vh IS NOT NULL GROUP BY ALL) SELECT p.c_custkey AS point_id, track, n_steps, first_t, last_t, vh FROM (SELECT c_custkey, c_custkey % 8 AS row, c_nationkey % 6 AS col FROM customer) p JOIN w USING (row, col) JOIN s USING (row, col, track)")
def arr26_27(spark, sf):
    """Series at points from the one track with most valid steps; tracks never mix."""
    pts = table(spark, sf, "customer").select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 8).alias("row"), (F.col("c_nationkey") % 6).cast("long").alias("col"))
    c = placed_cells(spark, sf).where("vv IS NOT NULL AND vh IS NOT NULL").join(pts.select("row", "col").distinct(), ["row", "col"], "left_semi")
    n = c.groupBy("row", "col", "track").agg(F.count("*").alias("n"))
    won = top_n(n, ["row", "col"], [F.col("n").desc(), F.col("track")]).select("row", "col", "track")
    # only the winners' steps are gathered, a month at a time: a task holds a month of steps or a series as text
    steps = F.array_sort(F.collect_list(F.struct("t", "scene_id", "seq", "place", F.col("vh").cast("decimal(4,2)").cast("string").alias("vh"))))
    months = c.join(won, ["row", "col", "track"], "left_semi").groupBy("row", "col", "track", "month").agg(steps.alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["vh"]), ",").alias("vh")
    months = months.select("row", "col", "track", "month", F.size("s").cast("long").alias("n"), F.element_at("s", 1)["t"].alias("first_t"), F.element_at("s", -1)["t"].alias("last_t"), text)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", "vh"))), lambda x: x["vh"]), ",")
    series = months.groupBy("row", "col", "track").agg(F.sum("n").alias("n_steps"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"), whole.alias("vh"))
    # points stream past their series: the other way round, one series would hold all its points' rows at a time
    shares = series.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(3))))
    points = pts.withColumn("share", F.pmod(F.xxhash64("point_id"), F.lit(4)).cast("int"))
    return points.join(shares.hint("merge"), ["row", "col", "share"]).select("point_id", "track", "n_steps", "first_t", "last_t", "vh")


@query("arr29_merge_groups", "SELECT month, row, col, arg_min(vv, ((4 - track) * 1000000 + scene_id) * 10 + seq) AS vv, count(DISTINCT track) AS n_groups FROM {C} WHERE vv > 0 AND vh > 0 GROUP BY ALL")
def arr29(spark, sf):
    order = tie_broken(((4 - F.col("track")) * 1_000_000 + F.col("scene_id")) * 10 + F.col("seq"), F.col("place"))
    return placed_cells(spark, sf).where("vv > 0 AND vh > 0").groupBy("month", "row", "col").agg(F.min_by("vv", order).alias("vv"), F.count_distinct("track").alias("n_groups"))


@query("arr31_tile_mosaic", "SELECT month, row, col, arg_min(vh, CASE WHEN track = 1 THEN 0 ELSE 1 END * 100000000 + scene_id * 10 + seq) FILTER (vh IS NOT NULL) AS vh FROM {C} WHERE track IN (1, 3) GROUP BY ALL")
def arr31(spark, sf):
    """Ascending before descending, nodata transparent; of scenes with one number the first in the table."""
    order = tie_broken(F.when(F.col("track") == 1, 0).otherwise(1) * 100_000_000 + F.col("scene_id") * 10 + F.col("seq"), F.col("place"))
    return placed_cells(spark, sf).where("track IN (1, 3)").groupBy("month", "row", "col").agg(F.min_by("vh", F.when(F.col("vh").isNotNull(), order)).alias("vh"))


@query("arr32_heatmap_data", "SELECT month, row, round(avg(vv), 6) AS vv FROM {C} GROUP BY ALL")
def arr32(spark, sf):
    return cells(spark, sf).groupBy("month", "row").agg(F.round(F.avg("vv"), 6).alias("vv"))


@query("arr34_shape_check", "SELECT block_id, count(*) = 64 AND min(row) = 0 AND max(row) = 7 AND min(col) = 0 AND max(col) = 7 AS whole FROM {D} GROUP BY ALL")
def arr34(spark, sf):
    whole = (F.count("*") == 64) & (F.min("row") == 0) & (F.max("row") == 7) & (F.min("col") == 0) & (F.max("col") == 7)
    return chunks(spark, sf).groupBy("block_id").agg(whole.alias("whole"))


@query("win19_spatial_gradient", "SELECT block_id, row, col, round(CAST(lead(v) OVER (PARTITION BY block_id, row ORDER BY col) AS DOUBLE) - CAST(v AS DOUBLE), 6) AS dx, round(CAST(lead(v) OVER (PARTITION BY block_id, col ORDER BY row) AS DOUBLE) - CAST(v AS DOUBLE), 6) AS dy FROM {D}")
def win19(spark, sf):
    d = chunks(spark, sf).withColumn("v", F.col("v").cast("double"))
    step = lambda a, b: F.round(F.lead("v").over(Window.partitionBy("block_id", a).orderBy(b)) - F.col("v"), 6)
    return d.select("block_id", "row", "col", step("row", "col").alias("dx"), step("col", "row").alias("dy"))
