"""Queries of product enumeration, validation, catalog rebuilds, logs, learning and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions.names import pass_id
from gridloom.operators import pu
from gridloom.operators.enumeration import Lookback, enumerate_products, multi_window
from gridloom.operators.relational import exact_percentiles, ranked, top_n
from gridloom.plans.bind import acquisitions, burst_lut, catalog, cells, query, table
from gridloom.sources import phase_log, sinks
from gridloom.streaming import cube


def _tiled(spark, sf):
    return acquisitions(spark, sf).join(F.broadcast(burst_lut(spark, sf)), "burst").withColumn("pass_id", pass_id(F.col("acq_dt")))


TILED = "(SELECT *, CAST(floor(epoch(acq_dt - TIMESTAMP '2014-01-01') / 518400) AS BIGINT) AS pass_id FROM {A} a JOIN {L} l USING (burst))"


def _enum_sql(windows, min_pre):
    parts = " UNION ".join(
        f"SELECT mgrs_tile_id, acq_group_id, pass_id, jpl_burst_id, pre_id AS opera_id FROM (SELECT w.*, h.opera_id AS pre_id, row_number() OVER (PARTITION BY w.mgrs_tile_id, w.acq_group_id, w.pass_id, w.jpl_burst_id ORDER BY h.acq_dt DESC, h.opera_id) AS k FROM w JOIN t h ON h.mgrs_tile_id = w.mgrs_tile_id AND h.acq_group_id = w.acq_group_id AND h.jpl_burst_id = w.jpl_burst_id AND h.polarizations = w.polarizations AND h.acq_dt >= w.post_min - INTERVAL {x.days + x.span} DAY AND h.acq_dt < w.post_min - INTERVAL {x.days} DAY) WHERE k <= {x.most}"
        for x in windows
    )
    return f"""WITH t AS {TILED}, f AS (SELECT mgrs_tile_id, acq_group_id, pass_id, min(acq_dt) AS post_min FROM t GROUP BY ALL),
    w AS (SELECT DISTINCT t.mgrs_tile_id, t.acq_group_id, t.pass_id, jpl_burst_id, polarizations, post_min FROM t JOIN f USING (mgrs_tile_id, acq_group_id, pass_id)),
    pre AS ({parts}), ok AS (SELECT mgrs_tile_id, acq_group_id, pass_id, jpl_burst_id FROM pre GROUP BY ALL HAVING count(*) >= {min_pre})
    SELECT mgrs_tile_id, acq_group_id, pass_id, jpl_burst_id, opera_id, 'post' AS category FROM t JOIN ok USING (mgrs_tile_id, acq_group_id, pass_id, jpl_burst_id)
    UNION ALL SELECT mgrs_tile_id, acq_group_id, pass_id, jpl_burst_id, opera_id, 'pre' FROM pre JOIN ok USING (mgrs_tile_id, acq_group_id, pass_id, jpl_burst_id)"""


IMMEDIATE, MULTI = [Lookback(0, 12, 3)], multi_window(5, 3, 4, 2)


@query("enu1_immediate_lookback", _enum_sql(IMMEDIATE, 2))
def enu1(spark, sf):
    return enumerate_products(_tiled(spark, sf), IMMEDIATE, 2)


@query("enu1_multi_window", _enum_sql(MULTI, 2))
def enu1_multi(spark, sf):
    return enumerate_products(_tiled(spark, sf), MULTI, 2)


@query("enu2_one_product", "SELECT * FROM (" + _enum_sql(IMMEDIATE, 1) + ") WHERE mgrs_tile_id = 'NATION_5' AND pass_id = 611")
def enu2(spark, sf):
    """The same plan; Spark pushes the product's filter into both sides."""
    return enumerate_products(_tiled(spark, sf), IMMEDIATE, 1).where("mgrs_tile_id = 'NATION_5' AND pass_id = 611")


@query("enu3_workflow_inputs", f"WITH t AS {TILED} SELECT mgrs_tile_id, acq_group_id, pass_id, min(acq_dt) AS acq_dt FROM t GROUP BY ALL HAVING min(acq_dt) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def enu3(spark, sf):
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    return _tiled(spark, sf).groupBy("mgrs_tile_id", "acq_group_id", "pass_id").agg(F.min("acq_dt").alias("acq_dt")).where(F.col("acq_dt").between(ts("2024-01-05"), ts("2024-01-20")))


@query("enu4_group_metadata", f"WITH t AS {TILED} SELECT mgrs_tile_id, jpl_burst_id, opera_id FROM (SELECT *, row_number() OVER (PARTITION BY mgrs_tile_id, jpl_burst_id ORDER BY acq_dt DESC, opera_id) AS k FROM t WHERE acq_group_id = 2) WHERE k <= 2")
def enu4(spark, sf):
    t = _tiled(spark, sf).where("acq_group_id = 2")
    return top_n(t, ["mgrs_tile_id", "jpl_burst_id"], [F.col("acq_dt").desc(), F.col("opera_id")], 2).select("mgrs_tile_id", "jpl_burst_id", "opera_id")


@query("enu5_bursts_of_tile_group", "SELECT DISTINCT burst FROM {L} WHERE acq_group_id IN (SELECT acq_group_id FROM {L} WHERE mgrs_tile_id = 'NATION_7')")
def enu5(spark, sf):
    lut = burst_lut(spark, sf)
    return lut.join(lut.where("mgrs_tile_id = 'NATION_7'").select("acq_group_id").distinct(), "acq_group_id", "left_semi").select("burst").distinct()


@query("enu6_earliest_date", "SELECT tile_id, min(month) AS first_month FROM {B} GROUP BY ALL")
def enu6(spark, sf):
    return catalog(spark, sf).groupBy("tile_id").agg(F.min("month").alias("first_month"))


@query("flt12_low_coverage_tracks", f"WITH t AS {TILED}, u AS (SELECT mgrs_tile_id, track_number, sum(area_km2) AS a FROM (SELECT DISTINCT mgrs_tile_id, track_number, burst, area_km2 FROM t) GROUP BY ALL) SELECT opera_id, mgrs_tile_id FROM t JOIN u USING (mgrs_tile_id, track_number) WHERE a >= 0.5 * 250")
def flt12(spark, sf):
    """Tracks whose distinct bursts cover enough of the tile; disjoint bursts' areas add up."""
    t = _tiled(spark, sf)
    area = t.select("mgrs_tile_id", "track_number", "burst", "area_km2").distinct().groupBy("mgrs_tile_id", "track_number").agg(F.sum("area_km2").alias("a"))
    good = area.where(F.col("a") >= 0.5 * 250)
    return t.join(good, ["mgrs_tile_id", "track_number"], "left_semi").select("opera_id", "mgrs_tile_id")


PREFILTER = f"""WITH t AS (SELECT *, CAST(acq_dt AS DATE) AS day FROM {TILED}), foot AS (SELECT DISTINCT track_number, burst FROM t), pres AS (SELECT DISTINCT track_number, pass_id, day, orbit_pass, burst FROM t),
    e AS (SELECT track_number, pass_id, day, orbit_pass, min(burst) AS lo, max(burst) AS hi, count(*) AS n FROM pres GROUP BY ALL),
    m AS (SELECT e.track_number, e.pass_id, e.day, e.orbit_pass, any_value(e.n) AS n, count(*) AS missing FROM e JOIN foot f ON f.track_number = e.track_number AND f.burst > lo AND f.burst < hi LEFT JOIN pres p ON p.track_number = e.track_number AND p.day = e.day AND p.orbit_pass = e.orbit_pass AND p.burst = f.burst WHERE p.burst IS NULL GROUP BY ALL)"""


@query("flt13_14_incomplete_passes", PREFILTER + " SELECT track_number, day, orbit_pass, missing, CASE WHEN (610 - pass_id) * 6 <= 30 THEN 'recoverable' ELSE 'permanent' END AS cause FROM m WHERE missing * 1.0 / (missing + n) > 0.3")
def flt13(spark, sf):
    """Acquisitions with holes inside a track: expected and present bursts as sets a group, which the footprint bounds."""
    t = _tiled(spark, sf).withColumn("day", F.to_date("acq_dt"))
    foot = t.groupBy("track_number").agg(F.collect_set("burst").alias("foot"))
    present = t.groupBy("track_number", "pass_id", "day", "orbit_pass").agg(F.collect_set("burst").alias("present"))
    inside = F.filter(F.array_except("foot", "present"), lambda b: (b > F.array_min("present")) & (b < F.array_max("present")))
    m = present.join(F.broadcast(foot), "track_number").withColumn("missing", F.size(inside).cast("long"))
    cause = F.when((610 - F.col("pass_id")) * 6 <= 30, "recoverable").otherwise("permanent")
    return m.where(F.col("missing") / (F.col("missing") + F.size("present")) > 0.3).select("track_number", "day", "orbit_pass", "missing", cause.alias("cause"))


CHECKS = """SELECT 'missing_path' AS chk, CAST(item_id AS VARCHAR) AS k, 'error' AS severity FROM {B} WHERE zarr_path IS NULL AND status = 'complete'
    UNION ALL SELECT 'bad_month', CAST(item_id AS VARCHAR), 'error' FROM {B} WHERE month > '2001-06' UNION ALL SELECT 'old_schema', CAST(item_id AS VARCHAR), 'warning' FROM {B} WHERE schema_version <> 8
    UNION ALL SELECT 'mixed_signature', zarr_path, 'error' FROM {B} WHERE zarr_path IS NOT NULL GROUP BY zarr_path HAVING count(DISTINCT processing_signature) > 1
    UNION ALL SELECT 'duplicate', tile_id || '|' || product_type || '|' || month, 'error' FROM {B} GROUP BY tile_id, product_type, month HAVING count(*) > 4"""


@query("val1_catalog_integrity", CHECKS)
def val1(spark, sf):
    """Row checks come from one scan: the array of a row's violations is exploded. Group checks follow."""
    b = catalog(spark, sf)
    hit = lambda name, cond, severity: F.when(cond, F.struct(F.lit(name).alias("chk"), F.col("item_id").cast("string").alias("k"), F.lit(severity).alias("severity")))
    rows = [hit("missing_path", F.col("zarr_path").isNull() & (F.col("status") == "complete"), "error"), hit("bad_month", F.col("month") > "2001-06", "error"), hit("old_schema", F.col("schema_version") != 8, "warning")]
    one = b.select(F.explode(F.array_compact(F.array(*rows))).alias("v")).select("v.*")
    signature = b.where("zarr_path IS NOT NULL").groupBy("zarr_path").agg(F.count_distinct("processing_signature").alias("n")).where("n > 1")
    twice = b.groupBy("tile_id", "product_type", "month").agg(F.count("*").alias("n")).where("n > 4")
    return one.unionByName(signature.select(F.lit("mixed_signature").alias("chk"), F.col("zarr_path").alias("k"), F.lit("error").alias("severity"))).unionByName(twice.select(F.lit("duplicate").alias("chk"), F.concat_ws("|", "tile_id", "product_type", "month").alias("k"), F.lit("error").alias("severity")))


@query("val2_column_checks", "SELECT 'flight_direction' AS col, count(*) - count(flight_direction) AS n_null FROM {B} UNION ALL SELECT 'grid_id', count(*) - count(grid_id) FROM {B} UNION ALL SELECT 'zarr_path', count(*) - count(zarr_path) FROM {B}")
def val2(spark, sf):
    names = ["flight_direction", "grid_id", "zarr_path"]
    counts = catalog(spark, sf).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("n_null")) for c in names])).alias("x")).select("x.*")


@query("val3_functional_dependency", "SELECT product_type, count(DISTINCT processing_signature) AS n FROM {B} GROUP BY ALL HAVING count(DISTINCT processing_signature) > 1")
def val3(spark, sf):
    return catalog(spark, sf).groupBy("product_type").agg(F.count_distinct("processing_signature").alias("n")).where("n > 1")


@query("val4_record_rules", "SELECT 'dup_link' AS rule, CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'no_output', CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 40 <> 0)")
def val4(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    dup = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("dup_link").alias("rule"), k.alias("k"))
    good = table(spark, sf, "orders").where("o_orderkey % 40 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return dup.unionByName(li.join(good, "l_orderkey", "left_anti").select(F.lit("no_output").alias("rule"), k.alias("k")))


@query("val5_numeric_rules", "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_tax > 0.07 THEN 'tax' END, CASE WHEN l_quantity < 3 THEN 'quantity' END) AS broken FROM lineitem WHERE l_tax > 0.07 OR l_quantity < 3")
def val5(spark, sf):
    rules = {"tax": F.col("l_tax") > 0.07, "quantity": F.col("l_quantity") < 3}
    broken = F.concat_ws(",", *[F.when(c, n) for n, c in rules.items()])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", broken.alias("broken")).where("broken <> ''")


@query("val6_store_structure", "SELECT conv_id, bool_and(ok) AS monotone, max(turn) AS last_turn FROM (SELECT conv_id, turn, coalesce(turn > lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), true) AS ok FROM conversations) GROUP BY ALL")
def val6(spark, sf):
    c = table(spark, sf, "conversations").withColumn("ok", F.coalesce(F.col("turn") > F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(True)))
    return c.groupBy("conv_id").agg(F.bool_and("ok").alias("monotone"), F.max("turn").alias("last_turn"))


@query("val7_grid_consistency", "SELECT tile_id, count(DISTINCT grid_id) AS n FROM {B} GROUP BY ALL HAVING count(DISTINCT grid_id) > 1")
def val7(spark, sf):
    return catalog(spark, sf).groupBy("tile_id").agg(F.count_distinct("grid_id").alias("n")).where("n > 1")


@query("val8_resync_stores", "SELECT zarr_path, min(datetime) AS start_dt, max(datetime) AS end_dt, count(*) AS n, string_agg(DISTINCT product_type, ',' ORDER BY product_type) AS types FROM {B} WHERE zarr_path IS NOT NULL GROUP BY ALL")
def val8(spark, sf):
    """One row a store from its time steps."""
    return catalog(spark, sf).where("zarr_path IS NOT NULL").groupBy("zarr_path").agg(F.min("datetime").alias("start_dt"), F.max("datetime").alias("end_dt"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("product_type")), ",").alias("types"))


@query("val9_inventory_suffix_match", "WITH r AS (SELECT DISTINCT string_split(zarr_path, '/')[2] AS want FROM {B} WHERE zarr_path IS NOT NULL) SELECT want, count(DISTINCT zarr_path) AS n FROM r JOIN {B} b ON ends_with(b.zarr_path, '/' || want) GROUP BY ALL")
def val9(spark, sf):
    """Stores by the last part of their path: the suffix is a key, so the match is an equal join."""
    b = catalog(spark, sf).where("zarr_path IS NOT NULL").withColumn("want", F.element_at(F.split("zarr_path", "/"), -1))
    return b.join(b.select("want").distinct(), "want").groupBy("want").agg(F.count_distinct("zarr_path").alias("n"))


@query("val10_source_sets", "WITH s AS (SELECT l_orderkey AS o, l_suppkey AS src FROM lineitem WHERE l_linenumber <= 3), u AS (SELECT l_orderkey AS o, l_suppkey AS src FROM lineitem WHERE l_linenumber >= 2) SELECT o, src, 'unused' AS what FROM (SELECT * FROM s EXCEPT SELECT * FROM u) UNION ALL SELECT o, src, 'unselected' FROM (SELECT * FROM u EXCEPT SELECT * FROM s)")
def val10(spark, sf):
    """Selected against used sources, one pass: each pair's two marks."""
    li = table(spark, sf, "lineitem").where("l_linenumber <= 3 OR l_linenumber >= 2")
    m = li.groupBy(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("src")).agg(F.bool_or(F.col("l_linenumber") <= 3).alias("s"), F.bool_or(F.col("l_linenumber") >= 2).alias("u"))
    return m.where("s <> u").select("o", "src", F.when(F.col("s"), "unused").otherwise("unselected").alias("what"))


@query("reg1_registry_overlay", "SELECT k, max_by(v, layer) AS v FROM (SELECT n_name AS k, 'base' || n_regionkey AS v, 0 AS layer FROM nation UNION ALL SELECT n_name, 'site', 1 FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_name, 'job', 2 FROM nation WHERE n_nationkey % 5 = 0) GROUP BY ALL")
def reg1(spark, sf):
    """Layers of settings; the later one wins."""
    n = table(spark, sf, "nation")
    layer = F.array(F.struct(F.lit(0).alias("layer"), F.concat(F.lit("base"), F.col("n_regionkey").cast("string")).alias("v")), F.when(F.col("n_nationkey") % 3 == 0, F.struct(F.lit(1).alias("layer"), F.lit("site").alias("v"))), F.when(F.col("n_nationkey") % 5 == 0, F.struct(F.lit(2).alias("layer"), F.lit("job").alias("v"))))
    return n.select(F.col("n_name").alias("k"), F.array_max(layer)["v"].alias("v"))


@query("flt21_unknown_config_keys", "SELECT DISTINCT json_keys(CAST(props AS JSON))[1] AS k FROM events WHERE json_keys(CAST(props AS JSON))[1] NOT IN ('known')")
def flt21(spark, sf):
    keys = F.array_except(F.map_keys(F.from_json("props", "map<string,string>")), F.array(F.lit("known")))
    return table(spark, sf, "events").select(F.explode(keys).alias("k")).distinct()


@query("src22_band_fallback", "SELECT scene_id, seq, round(CASE WHEN scene_id % 2 = 0 THEN vv ELSE pow(10, (10 * log10(vv)) / 10) END, 6) AS vv FROM {C} WHERE vv > 0")
def src22(spark, sf):
    from gridloom.functions.radar import from_db, to_db

    lin = F.when(F.col("scene_id") % 2 == 0, F.col("vv"))
    return cells(spark, sf).where("vv > 0").select("scene_id", "seq", F.round(F.coalesce(lin, from_db(to_db(F.col("vv")))), 6).alias("vv"))


@query("src25_distinct_grids", "SELECT b.item_id, g.n FROM {B} b LEFT JOIN (SELECT grid_id, length(grid_id) * 10 AS n FROM (SELECT DISTINCT grid_id FROM {B} WHERE grid_id IS NOT NULL)) g ON b.grid_id = g.grid_id")
def src25(spark, sf):
    """Work that depends on the grid alone is done once a distinct grid, then joined back."""
    b = catalog(spark, sf).select("item_id", "grid_id")
    g = b.where("grid_id IS NOT NULL").select("grid_id").distinct().withColumn("n", (F.length("grid_id") * 10).cast("long"))
    return b.join(g, "grid_id", "left").select("item_id", "n")


def _log_lines(spark, sf):
    e = table(spark, sf, "events")
    event = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "START").otherwise("END")
    return e.select(F.format_string("2024-01-01 INFO [PHASE] %s %s tile=T%d elapsed=%.2fs rss=%dMB delta=%dMB", F.col("event_type"), event, F.col("user_id") % 9, "value", F.col("user_id") + 300, F.col("user_id") % 40).alias("value")).unionByName(spark.range(3).select(F.lit("no phase here").alias("value")))


@query("agg33_src27_phase_log", "SELECT 'T' || (user_id % 9) AS tile, event_type AS phase, count(*) AS n, round(sum(value), 6) AS elapsed, CAST(max(user_id + 300) AS DOUBLE) AS max_rss, CAST(max(user_id % 40) AS DOUBLE) AS max_delta, count(*) FILTER (event_type = 'error') AS n_failed FROM events WHERE event_type <> 'view' GROUP BY ALL")
def agg33(spark, sf):
    return phase_log.summarize(phase_log.parse(_log_lines(spark, sf)))


@query("msc1_static_from_catalog", "SELECT DISTINCT tile_id, zarr_path FROM {B} WHERE product_type IN ('1-URGENT', '2-HIGH') AND geometry_group_id = 1 AND zarr_path IS NOT NULL")
def msc1(spark, sf):
    return catalog(spark, sf).where("product_type IN ('1-URGENT', '2-HIGH') AND geometry_group_id = 1 AND zarr_path IS NOT NULL").select("tile_id", "zarr_path").distinct()


@query("msc2_3_static_mosaic", "SELECT p_partkey % 8 AS row, p_size % 6 AS col, arg_min(p_retailprice, p_partkey) FILTER (p_partkey % 3 <> 0) AS lia FROM part GROUP BY ALL")
def msc2_3(spark, sf):
    p = table(spark, sf, "part")
    v = F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey"))
    return p.groupBy((F.col("p_partkey") % 8).alias("row"), (F.col("p_size") % 6).alias("col")).agg(F.min_by("p_retailprice", v).alias("lia"))


@query("msc5_minute_groups", "SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07' GROUP BY ALL")
def msc5(spark, sf):
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    e = table(spark, sf, "events").where(F.col("ts").between(ts("2024-01-05"), ts("2024-01-07")))
    return e.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"))


@query("msc7_retry_set", "SELECT event_id FROM events WHERE event_type = 'error' AND event_id NOT IN (SELECT event_id FROM events WHERE user_id % 5 = 0)")
def msc7(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'error'").join(e.where("user_id % 5 = 0").select("event_id"), "event_id", "left_anti").select("event_id")


@query("msc9_tile_grid", "SELECT s_suppkey, CAST(floor(s_acctbal / 30) * 30 AS DOUBLE) AS xmin, CAST(ceil((s_acctbal + 1000) / 30) - floor(s_acctbal / 30) AS BIGINT) AS width FROM supplier")
def msc9(spark, sf):
    lo, hi = F.floor(F.col("s_acctbal") / 30), F.ceil((F.col("s_acctbal") + 1000) / 30)
    return table(spark, sf, "supplier").select("s_suppkey", (lo * 30.0).alias("xmin"), (hi - lo).alias("width"))


@query("msc10_tile_integrity", "SELECT DISTINCT tile_id, month FROM {B} d WHERE product_type = '2-HIGH' AND NOT EXISTS (SELECT 1 FROM {B} p WHERE p.product_type = '1-URGENT' AND p.tile_id = d.tile_id AND p.month = d.month)")
def msc10(spark, sf):
    b = catalog(spark, sf)
    return b.where("product_type = '2-HIGH'").select("tile_id", "month").distinct().join(b.where("product_type = '1-URGENT'").select("tile_id", "month"), ["tile_id", "month"], "left_anti")


@query("msc11_scene_bounds", "SELECT s_suppkey FROM supplier WHERE CASE WHEN s_suppkey % 4 = 0 THEN true ELSE s_acctbal BETWEEN 1000 AND 5000 END")
def msc11(spark, sf):
    """Unknown bounds may cover anything."""
    overlap = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal").between(1000, 5000))
    return table(spark, sf, "supplier").where(F.coalesce(overlap, F.lit(True))).select("s_suppkey")


@query("msc12_resolve_bands", "SELECT item_id, coalesce(grid_id, zarr_path, 'VV,VH') AS bands FROM {B}")
def msc12(spark, sf):
    return catalog(spark, sf).select("item_id", F.coalesce("grid_id", "zarr_path", F.lit("VV,VH")).alias("bands"))


@query("msc13_plan_tokens", "SELECT DISTINCT upper(trim(t)) AS tile, upper(trim(t)) IN (SELECT n_name FROM nation) AS known FROM (SELECT unnest(string_split('nation_3, NATION_4 ,nation_3,LOST', ',')) AS t)")
def msc13(spark, sf):
    t = spark.range(1).select(F.explode(F.array_distinct(F.transform(F.split(F.lit("nation_3, NATION_4 ,nation_3,LOST"), ","), lambda x: F.upper(F.trim(x))))).alias("tile"))
    n = table(spark, sf, "nation").select(F.col("n_name").alias("tile"), F.lit(True).alias("known"))
    return t.join(n, "tile", "left").select("tile", F.coalesce("known", F.lit(False)).alias("known"))


@query("msc15_percentile_clip", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem GROUP BY ALL")
def msc15(spark, sf):
    return exact_percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"lo": 0.02, "hi": 0.98})


@query("msc16_determinism", "SELECT count(*) AS n, round(sum(vv), 4) AS total FROM {C}")
def msc16(spark, sf):
    return cells(spark, sf).repartition(7).agg(F.count("*").alias("n"), F.round(F.sum("vv"), 4).alias("total"))


@query("snk19_training_cube", "WITH s AS (SELECT row, col, track, median(vv) AS vv, median(vh) AS vh FROM {C} GROUP BY ALL), d AS (SELECT p_partkey % 8 AS row, p_size % 6 AS col, min(p_retailprice) AS dem FROM part GROUP BY ALL) SELECT s.row, s.col, track, round(vv, 6) AS vv, round(vh, 6) AS vh, dem FROM s LEFT JOIN d ON s.row = d.row AND s.col = d.col")
def snk19(spark, sf):
    s = cells(spark, sf).groupBy("row", "col", "track").agg(F.round(F.median("vv"), 6).alias("vv"), F.round(F.median("vh"), 6).alias("vh"))
    d = table(spark, sf, "part").groupBy((F.col("p_partkey") % 8).alias("row"), (F.col("p_size") % 6).cast("long").alias("col")).agg(F.min("p_retailprice").alias("dem"))
    return s.join(d, ["row", "col"], "left").select("row", "col", "track", "vv", "vh", "dem")


BAND_STATS = " UNION ALL ".join(f"SELECT '{b}' AS band, count({b}) AS n, round(avg({b}), 6) AS mean, round(stddev_pop({b}), 6) AS std, min({b}) AS min, max({b}) AS max FROM {{C}}" for b in ("vv", "vh"))


@query("snk21_band_stats_json", BAND_STATS)
def snk21(spark, sf):
    """Statistics of each band, saved as JSON and loaded again."""
    path, stats = f"{cube.scratch(spark)}/stats", sinks.band_stats(cells(spark, sf), ["vv", "vh"])
    stats.write.json(path)
    return spark.read.schema(stats.schema).json(path).select("band", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query("snk23_time_order", "SELECT scene_id, seq, row_number() OVER (PARTITION BY track, month ORDER BY t, scene_id, seq) AS place FROM {C}")
def snk23(spark, sf):
    """Places along time within each store and month, which is how a store is rewritten in order."""
    return ranked(cells(spark, sf), ["track", "month"], [F.col("t"), F.col("scene_id"), F.col("seq")], "place").select("scene_id", "seq", F.col("place").cast("long").alias("place"))


@query("arr33_pu_learning")
def arr33(spark, sf):
    """Documents labelled of good quality are the positives; text statistics are the features."""
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    d = table(spark, sf, "documents").select("doc_id", F.log1p(F.length(text)).alias("x0"), (F.regexp_count(text, F.lit("[A-Z]")) / n).alias("x1"), (F.regexp_count(text, F.lit("[^\\p{L}\\s]")) / n).alias("x2"), (F.regexp_count(text, F.lit("\\s")) / n).alias("x3"))
    # the fits read their rows several times; texts are read and searched once, and not moved
    path = f"{cube.scratch(spark)}/features"
    d.write.parquet(path)
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("s"))
    rows = spark.read.parquet(path).join(good, "doc_id", "left").select("doc_id", F.coalesce("s", F.lit(0)).alias("s"), "x0", "x1", "x2", "x3")
    model = pu.fit(rows, ["x0", "x1", "x2", "x3"])
    return model.predict_proba(rows).select("doc_id", "s", F.round("probability_positive", 6).alias("p"))


@query("str1_append_new_steps", "SELECT DISTINCT user_id % 70 AS store, CAST(ts AS DATE) AS day FROM events WHERE (user_id % 70, CAST(ts AS DATE)) NOT IN (SELECT (user_id % 70, CAST(ts AS DATE)) FROM events WHERE event_type = 'signup')")
def str1(spark, sf):
    """The store has the steps of sign-ups already; the others are appended once, whichever batch brings them."""
    step = [(F.col("user_id") % 70).alias("store"), F.to_date("ts").alias("day")]
    there = table(spark, sf, "events").where("event_type = 'signup'").select(*step)
    return cube.append_new_steps(cube.stream(spark, f"{sf}/events.parquet").select(*step, "event_id"), ["store", "day"], there).select("store", "day")


@query("str2_late_data", "SELECT event_id, CASE WHEN epoch((SELECT max(ts) FROM events)) - epoch(ts) > 20 * 86400 THEN 'permanent' ELSE 'recoverable' END AS cause FROM events WHERE event_type = 'error'")
def str2(spark, sf):
    s = cube.stream(spark, f"{sf}/events.parquet").select("event_id", "ts", "event_type")
    return cube.rejected_late(s, "ts", 20).where("event_type = 'error'").select("event_id", "cause")


@query("str3_footprints", "SELECT DISTINCT user_id % 7 AS track, user_id % 24 AS burst FROM events")
def str3(spark, sf):
    s = cube.stream(spark, f"{sf}/events.parquet").select((F.col("user_id") % 7).alias("track"), (F.col("user_id") % 24).alias("burst"))
    return cube.footprints(s, "track", "burst")


@query("str4_monthly_groups", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL")
def str4(spark, sf):
    return cube.monthly_counts(cube.stream(spark, f"{sf}/orders.parquet"), "o_orderdate")


@query("str5_distinct_steps", "SELECT DISTINCT user_id % 7 AS store, date_trunc('day', ts) AS t FROM events")
def str5(spark, sf):
    s = cube.stream(spark, f"{sf}/events.parquet").select((F.col("user_id") % 7).alias("store"), F.date_trunc("day", "ts").cast("timestamp").alias("t"))
    return cube.distinct_steps(s, ["store", "t"], "t").select("store", F.col("t").cast("timestamp_ntz").alias("t"))
