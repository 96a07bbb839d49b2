"""Queries of per-cell aggregates, mosaics and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import radar
from gridloom.operators import composite as comp
from gridloom.operators.relational import exact_percentiles, first_valid, mean_ranks, on_same, tie_broken
from gridloom.plans.bind import acquisitions, burst_lut, catalog, cells, chunks, placed_cells, query, table

PER_TRACK = "SELECT month, row, col, track, median(CASE WHEN vv > 0 THEN vv END) AS vv, median(CASE WHEN vh > 0 THEN vh END) AS vh, count(CASE WHEN vv > 0 THEN vv END) AS n_obs FROM {C} GROUP BY ALL"


@query("arr7_monthly_priority_composite", f"""
    WITH pt AS ({PER_TRACK}), cov AS (SELECT month, track, count(vv) AS c FROM pt GROUP BY ALL),
    pr AS (SELECT month, track, row_number() OVER (PARTITION BY month ORDER BY c DESC, track) AS p FROM cov),
    w AS (SELECT * FROM (SELECT pt.*, row_number() OVER (PARTITION BY pt.month, row, col ORDER BY p) AS k FROM pt JOIN pr USING (month, track) WHERE vv IS NOT NULL) WHERE k = 1)
    SELECT month, row, col, track, n_obs, round(CASE WHEN vv > 0 THEN 10 * log10(vv) END, 6) AS vv_db, round(CASE WHEN vh > 0 THEN 10 * log10(vh) END, 6) AS vh_db,
    round(CASE WHEN vv > 0 THEN vh / vv END, 6) AS ratio, round(CASE WHEN vv + vh > 0 THEN 4 * vh / (vv + vh) END, 6) AS rvi FROM w""")
def arr7(spark, sf):
    return comp.derived_bands(comp.priority_mosaic(cells(spark, sf)), 6).drop("vv", "vh")


def _method(method, sql_v):
    @query(f"agg1_composite_{method}", f"SELECT month, row, col, track, round({sql_v.format(v='vv')}, 6) AS vv, round({sql_v.format(v='vh')}, 6) AS vh, count(CASE WHEN vv > 0 THEN 1 END) AS n_obs FROM {{C}} GROUP BY ALL")
    def run(spark, sf):
        out = comp.composite(cells(spark, sf), ["month", "row", "col", "track"], method)
        return out.withColumns({"vv": F.round("vv", 6), "vh": F.round("vh", 6)})


for _m, _v in {"median": "median(CASE WHEN {v} > 0 THEN {v} END)", "min": "min(CASE WHEN {v} > 0 THEN {v} END)", "mean": "avg(CASE WHEN {v} > 0 THEN {v} END)"}.items():
    _method(_m, _v)


@query("agg2_trimmed_mean", """
    WITH r AS (SELECT month, row, col, vh, row_number() OVER (PARTITION BY month, row, col ORDER BY vh NULLS LAST) AS k, count(*) OVER (PARTITION BY month, row, col) AS n FROM {C})
    SELECT month, row, col, CASE WHEN sum(CASE WHEN vh IS NULL AND k > floor(n * 0.15) AND k <= n - floor(n * 0.15) THEN 1 ELSE 0 END) = 0
    THEN round(sum(CASE WHEN k > floor(n * 0.15) AND k <= n - floor(n * 0.15) THEN vh END) / (max(n) - 2 * floor(max(n) * 0.15)), 6) END AS vh FROM r GROUP BY ALL""")
def agg2(spark, sf):
    return cells(spark, sf).groupBy("month", "row", "col").agg(F.round(comp.trimmed_mean(F.col("vh"), 0.15), 6).alias("vh"))


@query("agg3_n_obs", "WITH g AS (SELECT DISTINCT row, col FROM {C}), m AS (SELECT DISTINCT month FROM {C}) SELECT m.month, g.row, g.col, count(c.vh) AS n_obs FROM g CROSS JOIN m LEFT JOIN {C} c ON c.row = g.row AND c.col = g.col AND c.month = m.month GROUP BY ALL")
def agg3(spark, sf):
    """Counts for every cell of the grid in every month, 0 where nothing was seen. The lattice is a grid's size, not the data's."""
    c = cells(spark, sf)
    seen = c.groupBy("month", "row", "col").agg(F.count("vh").alias("n"))
    months = seen.groupBy("row", "col").agg(F.lit(1).alias("one")).drop("one").join(F.broadcast(seen.select("month").distinct()), how="cross")
    return months.join(seen, ["month", "row", "col"], "left").select("month", "row", "col", F.coalesce("n", F.lit(0)).alias("n_obs"))


@query("agg4_track_coverage", "SELECT month, track, count(DISTINCT CASE WHEN vh IS NOT NULL THEN row * 6 + col END) AS covered FROM {C} GROUP BY ALL")
def agg4(spark, sf):
    """Cells with an observation: two grouped steps, so no distinct set is held."""
    per_cell = cells(spark, sf).groupBy("month", "track", "row", "col").agg(F.count("vh").alias("n"))
    return per_cell.groupBy("month", "track").agg(F.count(F.when(F.col("n") > 0, 1)).alias("covered"))


@query("agg5_track_valid_mask", "SELECT row, col, track, bool_or(vh IS NOT NULL) AS valid FROM {C} GROUP BY ALL")
def agg5(spark, sf):
    return cells(spark, sf).groupBy("row", "col", "track").agg(F.bool_or(F.col("vh").isNotNull()).alias("valid"))


@query("agg6_legacy_monthly_min", "SELECT month, row, col, min(vv) AS vv, min(vh) AS vh FROM {C} WHERE vv > 0.001 AND vh > 0.001 GROUP BY ALL")
def agg6(spark, sf):
    """The retired builder: both bands must be over the floor, the minimum is the composite."""
    both = cells(spark, sf).where((F.col("vv") > 0.001) & (F.col("vh") > 0.001))
    return both.groupBy("month", "row", "col").agg(F.min("vv").alias("vv"), F.min("vh").alias("vh"))


@query("agg7_metadata_by_burst", "SELECT jpl_burst_id, count(*) AS n, min(acq_dt) AS first_dt, max(acq_dt) AS last_dt FROM {A} GROUP BY ALL")
def agg7(spark, sf):
    return acquisitions(spark, sf).groupBy("jpl_burst_id").agg(F.count("*").alias("n"), F.min("acq_dt").alias("first_dt"), F.max("acq_dt").alias("last_dt"))


@query("agg8_pass_date", "SELECT opera_id, strftime(min(acq_dt) OVER (PARTITION BY burst, orbit_pass, floor(epoch(acq_dt - TIMESTAMP '2014-01-01') / 518400)), '%Y-%m-%d') AS acq_date FROM {A}")
def agg8(spark, sf):
    w = Window.partitionBy("burst", "orbit_pass", "pass_id")
    a = acquisitions(spark, sf).withColumn("pass_id", F.floor(F.timestamp_diff("SECOND", F.lit("2014-01-01").cast("timestamp_ntz"), F.col("acq_dt")) / 518400))
    return a.select("opera_id", F.date_format(F.min("acq_dt").over(w), "yyyy-MM-dd").alias("acq_date"))


@query("agg9_track_token", "SELECT mgrs_tile_id, acq_group_id, string_agg(CAST(track_number AS VARCHAR), '_' ORDER BY track_number) AS track_token FROM (SELECT DISTINCT mgrs_tile_id, acq_group_id, track_number FROM {A} a JOIN {L} l USING (burst)) GROUP BY ALL")
def agg9(spark, sf):
    j = acquisitions(spark, sf).join(F.broadcast(burst_lut(spark, sf)), "burst")
    return j.groupBy("mgrs_tile_id", "acq_group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("track_number")), lambda x: x.cast("string")), "_").alias("track_token"))


@query("agg10_min_pre_images", "SELECT opera_id, jpl_burst_id FROM {A} QUALIFY count(*) OVER (PARTITION BY jpl_burst_id) >= 70")
def agg10(spark, sf):
    """Bursts with enough images: a grouped count and a semi join, which reads the wide rows once and shuffles none of them for the count."""
    a = acquisitions(spark, sf)
    enough = a.groupBy("jpl_burst_id").count().where("count >= 70")
    return a.join(enough, "jpl_burst_id", "left_semi").select("opera_id", "jpl_burst_id")


@query("agg11_catalog_statistics", "SELECT tile_id, flight_direction, CAST(grouping(tile_id) + grouping(flight_direction) AS BIGINT) AS level, count(*) AS n, count(DISTINCT month) AS n_months, min(datetime) AS first_dt, max(datetime) AS last_dt FROM {B} GROUP BY GROUPING SETS ((), (tile_id), (tile_id, flight_direction))")
def agg11(spark, sf):
    b = catalog(spark, sf)
    sets = b.groupingSets([[], ["tile_id"], ["tile_id", "flight_direction"]], "tile_id", "flight_direction")
    return sets.agg((F.grouping("tile_id").cast("long") + F.grouping("flight_direction").cast("long")).alias("level"), F.count("*").alias("n"), F.count_distinct("month").alias("n_months"), F.min("datetime").alias("first_dt"), F.max("datetime").alias("last_dt"))


GAP_SQL = """WITH h AS (SELECT DISTINCT tile_id, flight_direction, month FROM {B}), s AS (SELECT tile_id, flight_direction, min(month) AS a, max(month) AS b, count(*) AS present FROM h GROUP BY ALL),
    w AS (SELECT tile_id, flight_direction, strftime(unnest(range(CAST(a || '-01' AS TIMESTAMP), CAST(b || '-01' AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM s)"""


@query("agg12_coverage_report", GAP_SQL + " SELECT s.tile_id, s.flight_direction, max(present) AS present, count(*) AS expected, round(100.0 * max(present) / count(*), 4) AS completeness FROM s JOIN w ON s.tile_id = w.tile_id AND s.flight_direction IS NOT DISTINCT FROM w.flight_direction GROUP BY s.tile_id, s.flight_direction")
def agg12(spark, sf):
    b = catalog(spark, sf).groupBy("tile_id", "flight_direction").agg(F.count_distinct("month").alias("present"), F.min("month").alias("a"), F.max("month").alias("b"))
    expected = (F.substring("b", 1, 4).cast("int") - F.substring("a", 1, 4).cast("int")) * 12 + F.substring("b", 6, 2).cast("int") - F.substring("a", 6, 2).cast("int") + 1
    return b.withColumn("expected", expected.cast("long")).select("tile_id", "flight_direction", "present", "expected", F.round(100.0 * F.col("present") / F.col("expected"), 4).alias("completeness"))


@query("agg13_temporal_gaps", GAP_SQL + " SELECT tile_id, flight_direction, string_agg(month, ',' ORDER BY month) AS missing, count(*) AS n FROM (SELECT w.* FROM w LEFT JOIN h ON h.tile_id = w.tile_id AND h.flight_direction IS NOT DISTINCT FROM w.flight_direction AND h.month = w.month WHERE h.month IS NULL) GROUP BY ALL")
def agg13(spark, sf):
    from gridloom.operators.relational import missing_months

    gaps = missing_months(catalog(spark, sf), ["tile_id", "flight_direction"])
    return gaps.groupBy("tile_id", "flight_direction").agg(F.array_join(F.array_sort(F.collect_list("month")), ",").alias("missing"), F.count("*").alias("n"))


@query("agg14_tile_statistics", "SELECT flight_direction, count(*) AS n, count(DISTINCT month) AS n_months, min(month) AS first_month, max(month) AS last_month FROM {B} WHERE tile_id = 'NATION_3' GROUP BY ALL")
def agg14(spark, sf):
    return catalog(spark, sf).where("tile_id = 'NATION_3'").groupBy("flight_direction").agg(F.count("*").alias("n"), F.count_distinct("month").alias("n_months"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


@query("agg15_catalog_report", "SELECT 'product_type' AS what, product_type AS value, count(*) AS n FROM {B} GROUP BY ALL UNION ALL SELECT 'direction', flight_direction, count(*) FROM {B} GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM {B} GROUP BY ALL")
def agg15(spark, sf):
    """Three value counts in one pass: a row of three (what, value) pairs is unpivoted behind the scan."""
    b = catalog(spark, sf)
    long = b.select(F.explode(F.array(*[F.struct(F.lit(w).alias("what"), F.col(c).alias("value")) for w, c in (("product_type", "product_type"), ("direction", "flight_direction"), ("status", "status"))])).alias("x")).select("x.*")
    return long.groupBy("what", "value").agg(F.count("*").alias("n"))


@query("agg16_collection_extent", "SELECT min(c_acctbal) AS xmin, max(c_acctbal) AS xmax, min(o_orderdate) AS first_dt, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)) AS types FROM orders JOIN customer ON o_custkey = c_custkey")
def agg16(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.agg(F.min("c_acctbal").alias("xmin"), F.max("c_acctbal").alias("xmax"), F.min("o_orderdate").alias("first_dt"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("types"))


@query("agg17_tiles", "SELECT tile_id, count(*) AS n, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT b2.flight_direction AS x FROM {B} b2 WHERE b2.tile_id = b.tile_id)) AS directions, min(month) AS first_month, max(month) AS last_month FROM {B} b GROUP BY tile_id")
def agg17(spark, sf):
    return catalog(spark, sf).groupBy("tile_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("flight_direction")), ",").alias("directions"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


@query("agg18_month_histogram", "SELECT month, count(*) AS n FROM {B} WHERE product_type = '1-URGENT' GROUP BY ALL")
def agg18(spark, sf):
    return catalog(spark, sf).where("product_type = '1-URGENT'").groupBy("month").agg(F.count("*").alias("n"))


@query("agg19_peak_batch_counts", "SELECT max(CASE WHEN g = 'y' THEN n END) AS peak_year, max(CASE WHEN g = 'q' THEN n END) AS peak_quarter, max(CASE WHEN g = 'm' THEN n END) AS peak_month FROM (SELECT 'y' AS g, count(*) AS n FROM orders GROUP BY year(o_orderdate) UNION ALL SELECT 'q', count(*) FROM orders GROUP BY year(o_orderdate), quarter(o_orderdate) UNION ALL SELECT 'm', count(*) FROM orders GROUP BY year(o_orderdate), month(o_orderdate))")
def agg19(spark, sf):
    """Counted by month once; quarters and years are sums of months."""
    m = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    q = m.groupBy("y", F.ceil(F.col("m") / 3).alias("q")).agg(F.sum("n").alias("nq"), F.max("n").alias("nm"))
    y = q.groupBy("y").agg(F.sum("nq").alias("ny"), F.max("nq").alias("nq"), F.max("nm").alias("nm"))
    return y.agg(F.max("ny").alias("peak_year"), F.max("nq").alias("peak_quarter"), F.max("nm").alias("peak_month"))


@query("agg20_group_by_period", "SELECT month, count(DISTINCT scene_id) AS n_scenes FROM {C} GROUP BY ALL")
def agg20(spark, sf):
    return cells(spark, sf).groupBy("month").agg(F.count_distinct("scene_id").alias("n_scenes"))


@query("agg21_static_groups", """WITH g AS (SELECT orbit_pass, acq_group_id, string_agg(DISTINCT CAST(track_number AS VARCHAR), '_' ORDER BY CAST(track_number AS VARCHAR)) AS token, count(DISTINCT jpl_burst_id) AS n_bursts, count(*) AS n FROM {A} a JOIN {L} l USING (burst) GROUP BY ALL)
    SELECT orbit_pass, acq_group_id, token, n_bursts, row_number() OVER (PARTITION BY orbit_pass ORDER BY n DESC, acq_group_id) = 1 AS is_primary FROM g""")
def agg21(spark, sf):
    j = acquisitions(spark, sf).join(F.broadcast(burst_lut(spark, sf)), "burst")
    g = j.groupBy("orbit_pass", "acq_group_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("track_number").cast("string"))), "_").alias("token"), F.count_distinct("jpl_burst_id").alias("n_bursts"), F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("orbit_pass").orderBy(F.col("n").desc(), "acq_group_id")) == 1
    return g.select("orbit_pass", "acq_group_id", "token", "n_bursts", first.alias("is_primary"))


@query("agg22_burst_time_range", "SELECT user_id % 24 AS burst, min(try_cast(CASE WHEN event_id % 5 = 0 THEN 'not a time' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP)) AS first_dt, max(try_cast(CASE WHEN event_id % 5 = 0 THEN 'not a time' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP)) AS last_dt FROM events GROUP BY ALL")
def agg22(spark, sf):
    """Times that do not parse are skipped."""
    raw = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    t = raw.try_cast("timestamp_ntz")
    return table(spark, sf, "events").groupBy((F.col("user_id") % 24).alias("burst")).agg(F.min(t).alias("first_dt"), F.max(t).alias("last_dt"))


@query("agg23_band_stats", "SELECT band, count(v) AS n, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, min(v) AS lo, max(v) AS hi FROM {D} GROUP BY ALL")
def agg23(spark, sf):
    v = F.col("v").cast("double")
    return chunks(spark, sf).groupBy("band").agg(F.count("v").alias("n"), F.round(F.avg(v), 5).alias("mean"), F.round(F.stddev_pop(v), 5).alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("agg24_series_statistics", "SELECT row, col, round(avg(vv), 6) AS mean, round(stddev_pop(vv), 6) AS std, min(vv) AS lo, max(vv) AS hi, round(median(vv), 6) AS med FROM {C} GROUP BY ALL")
def agg24(spark, sf):
    return cells(spark, sf).groupBy("row", "col").agg(F.round(F.avg("vv"), 6).alias("mean"), F.round(F.stddev_pop("vv"), 6).alias("std"), F.min("vv").alias("lo"), F.max("vv").alias("hi"), F.round(F.median("vv"), 6).alias("med"))


@query("agg25_region_timeseries", "SELECT t, round(avg(vv), 6) AS vv, round(avg(vh), 6) AS vh FROM {C} WHERE row BETWEEN 2 AND 5 AND col BETWEEN 1 AND 4 GROUP BY t HAVING count(vv) > 0 AND count(vh) > 0")
def agg25(spark, sf):
    r = cells(spark, sf).where("row BETWEEN 2 AND 5 AND col BETWEEN 1 AND 4").groupBy("t").agg(F.round(F.avg("vv"), 6).alias("vv"), F.round(F.avg("vh"), 6).alias("vh"))
    return r.dropna(subset=["vv", "vh"])


@query("agg26_cube_features", "SELECT row, col, round(avg(vv), 6) AS vv_mean, round(stddev_pop(vv), 6) AS vv_std, round(median(vv), 6) AS vv_median, min(vv) AS vv_min, max(vv) AS vv_max, round(avg(vh), 6) AS vh_mean, round(stddev_pop(vh), 6) AS vh_std, round(median(vh), 6) AS vh_median, min(vh) AS vh_min, max(vh) AS vh_max FROM {C} GROUP BY ALL")
def agg26(spark, sf):
    kinds = {"mean": F.avg, "std": F.stddev_pop, "median": F.median, "min": F.min, "max": F.max}
    return cells(spark, sf).groupBy("row", "col").agg(*[(F.round(f(b), 6) if k in ("mean", "std", "median") else f(b)).alias(f"{b}_{k}") for b in ("vv", "vh") for k, f in kinds.items()])


@query("agg27_quality_sample", "SELECT band, round(count(v) / count(*), 6) AS finite, min(v) AS lo, round(quantile_cont(CAST(v AS DOUBLE), 0.01), 5) AS p01, round(quantile_cont(CAST(v AS DOUBLE), 0.5), 5) AS med, round(quantile_cont(CAST(v AS DOUBLE), 0.99), 5) AS p99, max(v) AS hi FROM {D} GROUP BY ALL")
def agg27(spark, sf):
    v = F.col("v").cast("double")
    p = lambda q, n: F.round(F.percentile(v, q), 5).alias(n)
    return chunks(spark, sf).groupBy("band").agg(F.round(F.count("v") / F.count("*"), 6).alias("finite"), F.min("v").alias("lo"), p(0.01, "p01"), p(0.5, "med"), p(0.99, "p99"), F.max("v").alias("hi"))


SPEARMAN = "SELECT x, z, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY z) + (count(*) OVER (PARTITION BY g, z) - 1) / 2.0 AS rz, g FROM (SELECT l_quantity AS x, l_extendedprice AS z, l_returnflag || l_linestatus || (l_suppkey % 20) AS g FROM lineitem)"


@query("agg28_global_summary", f"SELECT g, count(*) AS n, round(median(z), 4) AS med, round(sum(z), 2) / count(z) AS mean, round(stddev_pop(z), 4) AS std, round(quantile_cont(z, 0.05), 4) AS p05, round(quantile_cont(z, 0.95), 4) AS p95, round(avg(CASE WHEN z > 30000 THEN 1.0 ELSE 0.0 END), 6) AS over, round(corr(rx, rz), 6) AS rho FROM ({SPEARMAN}) GROUP BY g")
def agg28(spark, sf):
    """Spearman's rho is the correlation of average ranks, ranked within each group so that no window is global."""
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("z"), F.concat("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 20).cast("string")).alias("g"))
    r = on_same(on_same(li, mean_ranks(li, "g", "x", "rx"), ["g", "x"]), mean_ranks(li, "g", "z", "rz"), ["g", "z"])
    s = r.groupBy("g").agg(F.count("*").alias("n"), (F.round(F.sum("z"), 2) / F.count("z")).alias("mean"), F.round(F.stddev_pop("z"), 4).alias("std"), F.round(F.avg((F.col("z") > 30000).cast("double")), 6).alias("over"), F.round(F.corr("rx", "rz"), 6).alias("rho"))
    p = exact_percentiles(li, ["g"], "z", {"med": 0.5, "p05": 0.05, "p95": 0.95})
    return on_same(s, p, ["g"]).select("g", "n", F.round("med", 4).alias("med"), "mean", "std", F.round("p05", 4).alias("p05"), F.round("p95", 4).alias("p95"), "over", "rho")


BIN_EDGES = (0, 5000, 20000, 40000, 60000, 80000)
BIN_CASE = "CASE " + " ".join(f"WHEN l_extendedprice < {b} THEN {i}" for i, b in enumerate(BIN_EDGES[1:])) + f" ELSE {len(BIN_EDGES) - 1} END"


@query("agg29_histogram_cumulative", f"SELECT bin, n, round(n / sum(n) OVER (), 8) AS frac, round(sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 8) AS cum FROM (SELECT CAST({BIN_CASE} AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY ALL)")
def agg29(spark, sf):
    """Counts first; the running sum goes over the few bins."""
    z = F.col("l_extendedprice")
    bin_ = F.lit(len(BIN_EDGES) - 1)
    for i, edge in reversed(list(enumerate(BIN_EDGES[1:]))):
        bin_ = F.when(z < edge, i).otherwise(bin_)
    c = table(spark, sf, "lineitem").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    total, run = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("bin", "n", F.round(F.col("n") / F.sum("n").over(total), 8).alias("frac"), F.round(F.sum("n").over(run) / F.sum("n").over(total), 8).alias("cum"))


@query("agg30_binned_stats", "SELECT b.lo, count(l_quantity) AS n, round(median(l_extendedprice), 4) AS med FROM (SELECT CAST(unnest(range(0, 60, 5)) AS BIGINT) AS lo) b LEFT JOIN lineitem ON l_quantity >= b.lo AND l_quantity < b.lo + 5 GROUP BY ALL")
def agg30(spark, sf):
    """Empty bins show up: rows are binned and grouped, then the few bins join the full list."""
    got = table(spark, sf, "lineitem").groupBy((F.floor(F.col("l_quantity") / 5) * 5).alias("lo")).agg(F.count("*").alias("n"), F.round(F.median("l_extendedprice"), 4).alias("med"))
    return spark.range(0, 60, 5, 1).withColumnRenamed("id", "lo").join(got, "lo", "left").select("lo", F.coalesce("n", F.lit(0)).alias("n"), "med")


@query("agg31_binned_2d", "SELECT CAST(floor(l_quantity / 2) AS BIGINT) AS bx, CAST(floor(l_discount * 100 / 2 + 1e-9) AS BIGINT) AS by, count(*) AS n, round(sum(l_extendedprice), 2) / count(l_extendedprice) AS mean, round(median(l_extendedprice), 4) AS med FROM lineitem GROUP BY ALL")
def agg31(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_quantity") / 2).alias("bx"), F.floor(F.col("l_discount") * 100 / 2 + 1e-9).alias("by")).agg(F.count("*").alias("n"), (F.round(F.sum("l_extendedprice"), 2) / F.count("l_extendedprice")).alias("mean"), F.round(F.median("l_extendedprice"), 4).alias("med"))


HEX_SQL = """WITH p AS (SELECT l_extendedprice AS z, l_quantity / 4 AS x, l_tax * 100 / 2 AS y FROM lineitem),
    h AS (SELECT z, round(x) AS x1, round(y) AS y1, floor(x) + 0.5 AS x2, floor(y) + 0.5 AS y2, x, y FROM p),
    c AS (SELECT z, CASE WHEN (x - x1) * (x - x1) + 3 * (y - y1) * (y - y1) < (x - x2) * (x - x2) + 3 * (y - y2) * (y - y2) THEN x1 ELSE x2 END AS hx, CASE WHEN (x - x1) * (x - x1) + 3 * (y - y1) * (y - y1) < (x - x2) * (x - x2) + 3 * (y - y2) * (y - y2) THEN y1 ELSE y2 END AS hy FROM h)"""


@query("agg32_hexbin_median", HEX_SQL + " SELECT hx, hy, count(*) AS n, round(median(z), 4) AS med FROM c GROUP BY ALL HAVING count(*) >= 5")
def agg32(spark, sf):
    """Two shifted lattices; a point goes to the nearer centre."""
    x, y = F.col("l_quantity") / 4, F.col("l_tax") * 100 / 2
    x1, y1, x2, y2 = F.round(x), F.round(y), F.floor(x) + 0.5, F.floor(y) + 0.5
    near = (x - x1) * (x - x1) + 3 * (y - y1) * (y - y1) < (x - x2) * (x - x2) + 3 * (y - y2) * (y - y2)
    h = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("z"), F.when(near, x1).otherwise(x2).alias("hx"), F.when(near, y1).otherwise(y2).alias("hy"))
    return h.groupBy("hx", "hy").agg(F.count("*").alias("n"), F.round(F.median("z"), 4).alias("med")).where("n >= 5")


@query("agg34_band_checksum", "SELECT block_id, round(sum(CAST(v AS DOUBLE)), 6) AS total, count(*) - count(v) AS n_missing FROM {D} GROUP BY ALL")
def agg34(spark, sf):
    return chunks(spark, sf).groupBy("block_id").agg(F.round(F.sum(F.col("v").cast("double")), 6).alias("total"), F.count_if(F.col("v").isNull()).alias("n_missing"))


@query("agg35_mixed_signatures", "SELECT zarr_path, count(DISTINCT processing_signature) AS n FROM {B} WHERE zarr_path IS NOT NULL GROUP BY ALL HAVING count(DISTINCT processing_signature) > 1")
def agg35(spark, sf):
    return catalog(spark, sf).where("zarr_path IS NOT NULL").groupBy("zarr_path").agg(F.count_distinct("processing_signature").alias("n")).where("n > 1")


@query("agg36_duplicates", "SELECT count(*) - count(DISTINCT (tile_id, coalesce(flight_direction, ''), product_type, month)) AS n_duplicates FROM {B}")
def agg36(spark, sf):
    per = catalog(spark, sf).groupBy("tile_id", "flight_direction", "product_type", "month").agg(F.count("*").alias("n"))
    return per.agg(F.sum(F.col("n") - 1).alias("n_duplicates"))


@query("agg37_month_provenance", "SELECT month, string_agg(DISTINCT CAST(track AS VARCHAR), ',' ORDER BY CAST(track AS VARCHAR)) AS tracks, min(scene_id) AS first_scene, count(DISTINCT scene_id) AS n_scenes FROM {C} GROUP BY ALL")
def agg37(spark, sf):
    return cells(spark, sf).groupBy("month").agg(F.array_join(F.array_sort(F.collect_set(F.col("track").cast("string"))), ",").alias("tracks"), F.min("scene_id").alias("first_scene"), F.count_distinct("scene_id").alias("n_scenes"))


@query("agg38_union_extent", "SELECT s_nationkey AS tile, floor(min(s_acctbal) / 30) * 30 AS xmin, ceil(max(s_acctbal) / 30) * 30 AS xmax FROM supplier GROUP BY ALL")
def agg38(spark, sf):
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("tile")).agg((F.floor(F.min("s_acctbal") / 30) * 30.0).alias("xmin"), (F.ceil(F.max("s_acctbal") / 30) * 30.0).alias("xmax"))


@query("agg40_coverage_fraction", "SELECT month, track, round(count(DISTINCT CASE WHEN vh IS NOT NULL THEN row * 6 + col END) / 48.0, 6) AS fraction FROM {C} GROUP BY ALL")
def agg40(spark, sf):
    return agg4(spark, sf).select("month", "track", F.round(F.col("covered") / 48, 6).alias("fraction"))


@query("agg41_run_summary", "SELECT count(*) FILTER (status = 'complete') AS ok, count(*) FILTER (status <> 'complete') AS failed, round(sum(size), 2) AS total FROM {B}")
def agg41(spark, sf):
    return catalog(spark, sf).agg(F.count_if(F.col("status") == "complete").alias("ok"), F.count_if(F.col("status") != "complete").alias("failed"), F.round(F.sum("size"), 2).alias("total"))


@query("agg42_percentile_stretch", "WITH p AS (SELECT band, quantile_cont(CAST(v AS DOUBLE), 0.02) AS lo, quantile_cont(CAST(v AS DOUBLE), 0.98) AS hi FROM {D} GROUP BY ALL) SELECT block_id, row, col, round(greatest(0.0, least(1.0, (CAST(v AS DOUBLE) - lo) / (hi - lo))), 5) AS s FROM {D} d JOIN p USING (band) WHERE v IS NOT NULL")
def agg42(spark, sf):
    d = chunks(spark, sf).withColumn("v", F.col("v").cast("double"))
    p = d.groupBy("band").agg(F.percentile("v", F.array(F.lit(0.02), F.lit(0.98))).alias("p"))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("p")[0]) / (F.col("p")[1] - F.col("p")[0])))
    return d.where("v IS NOT NULL").join(F.broadcast(p), "band").select("block_id", "row", "col", F.round(s, 5).alias("s"))


@query("agg43_catalog_inspect", "SELECT schema_version, count(*) AS n, count(*) FILTER (grid_id IS NULL) AS no_grid, count(*) FILTER (zarr_path IS NULL) AS no_path FROM {B} GROUP BY ALL")
def agg43(spark, sf):
    return catalog(spark, sf).groupBy("schema_version").agg(F.count("*").alias("n"), F.count_if(F.col("grid_id").isNull()).alias("no_grid"), F.count_if(F.col("zarr_path").isNull()).alias("no_path"))


@query("scl1_5_derived_bands", """SELECT scene_id, seq, round(10 * log10(vv), 6) AS vv_db, round(CASE WHEN vh > 0 THEN 10 * log10(vh) END, 6) AS vh_db, round(CASE WHEN vv > 0 THEN vh / vv END, 6) AS ratio, round(CASE WHEN vv + vh > 0 THEN 4 * vh / (vv + vh) END, 6) AS rvi,
    round(CASE WHEN vh > 1e-10 THEN vh / (vv + 1e-10) END, 6) AS old_ratio, round(CASE WHEN vh > 1e-10 THEN 4 * vh / (vv + vh + 1e-10) END, 6) AS old_rvi, round(pow(10, (10 * log10(vv)) / 10), 6) AS back FROM {C} WHERE vv > 0""")
def scl1_5(spark, sf):
    c = cells(spark, sf).where("vv > 0")
    vv, vh = F.col("vv"), F.col("vh")
    return comp.derived_bands(c, 6).select("scene_id", "seq", "vv_db", "vh_db", "ratio", "rvi", F.round(radar.legacy_ratio(vv, vh), 6).alias("old_ratio"), F.round(radar.legacy_rvi(vv, vh), 6).alias("old_rvi"), F.round(radar.from_db(radar.to_db(vv)), 6).alias("back"))


@query("scl9_10_byte_scaling", "SELECT block_id, row, col, CAST(coalesce(floor(least(greatest((CAST(v AS DOUBLE) + 0.3) / 0.6, 0), 1) * 255), 0) AS INTEGER) AS b, coalesce(v, -9999) AS filled FROM {D}")
def scl9_10(spark, sf):
    v = F.col("v").cast("double")
    return chunks(spark, sf).select("block_id", "row", "col", radar.to_byte(v, -0.3, 0.3).alias("b"), F.coalesce(F.col("v"), F.lit(radar.NODATA).cast("float")).alias("filled"))


@query("win9_10_first_valid_mosaic", "SELECT month, row, col, arg_min(vh, scene_id * 10 + seq) FILTER (vh IS NOT NULL) AS vh FROM {C} GROUP BY ALL")
def win9_10(spark, sf):
    return comp.first_valid_mosaic(placed_cells(spark, sf), ["month", "row", "col"], tie_broken(F.col("scene_id") * 10 + F.col("seq"), F.col("place")), "vh")


@query("win11_merge_group_priority", "SELECT t, row, col, vv, vh FROM (SELECT *, row_number() OVER (PARTITION BY t, row, col ORDER BY track DESC, scene_id, seq) AS k FROM {C} WHERE vv IS NOT NULL AND vh IS NOT NULL) WHERE k = 1")
def win11(spark, sf):
    c = cells(spark, sf)
    both = F.col("vv").isNotNull() & F.col("vh").isNotNull()
    best = c.groupBy("t", "row", "col").agg(first_valid(F.struct("vv", "vh"), F.struct(-F.col("track"), "scene_id", "seq"), both).alias("b"))
    return best.where("b IS NOT NULL").select("t", "row", "col", "b.*")
