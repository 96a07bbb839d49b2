"""Queries of filters, joins, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import joins
from gridloom.operators.relational import keyed_hash, least_hashed, pick, replace_keys, top_n, upsert
from gridloom.plans.bind import acquisitions, burst_lut, catalog, cells, query, table


@query("prj1_2_reorder_adapt", "SELECT opera_id, jpl_burst_id, acq_dt AS acq_datetime, orbit_pass FROM {A}")
def prj1_2(spark, sf):
    want = ["opera_id", "jpl_burst_id", "acq_dt", "orbit_pass", "not_there"]
    a = acquisitions(spark, sf)
    return a.select(*[c for c in want if c in a.columns]).withColumnRenamed("acq_dt", "acq_datetime")


@query("src1_4_lut_pushdown", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 5, 7)")
def src1_4(spark, sf):
    return table(spark, sf, "nation").where(F.col("n_nationkey").isin(3, 5, 7)).select("n_nationkey", "n_name")


@query("src5_metadata_scan", "SELECT opera_id, acq_dt, split_part(url_copol, '/', 4) AS file FROM (SELECT *, row_number() OVER (PARTITION BY jpl_burst_id, CAST(acq_dt AS DATE) ORDER BY acq_dt, event_id) AS k FROM {A} WHERE polarizations IN ('VV+VH', 'HH+HV')) WHERE k = 1 AND url_copol IS NOT NULL")
def src5(spark, sf):
    a = acquisitions(spark, sf).where(F.col("polarizations").isin("HH+HV", "VV+VH")).withColumn("day", F.to_date("acq_dt"))
    one = pick(a, ["jpl_burst_id", "day"], ["opera_id", "acq_dt", "url_copol"], F.struct("acq_dt", "event_id"))
    return one.where("url_copol IS NOT NULL").select("opera_id", "acq_dt", F.element_at(F.split("url_copol", "/"), 4).alias("file"))


@query("src8_9_union_of_ranges", "SELECT DISTINCT opera_id, acq_dt FROM {A} WHERE (acq_dt >= TIMESTAMP '2024-01-03' AND acq_dt <= TIMESTAMP '2024-01-09') OR (acq_dt >= TIMESTAMP '2024-01-08' AND acq_dt <= TIMESTAMP '2024-01-12')")
def src8_9(spark, sf):
    """Overlapping ranges: the union of the scans, one row an id. As one disjunction it is one scan and needs no deduplication across ranges."""
    t = F.col("acq_dt")
    ranges = [("2024-01-03", "2024-01-09"), ("2024-01-08", "2024-01-12")]
    any_ = F.lit(False)
    for a, b in ranges:
        any_ = any_ | ((t >= F.lit(a).cast("timestamp_ntz")) & (t <= F.lit(b).cast("timestamp_ntz")))
    return acquisitions(spark, sf).where(any_).select("opera_id", "acq_dt").distinct()


@query("src12_13_paired_bands", "SELECT scene_id, row, col, count(*) AS n FROM {C} WHERE vv IS NOT NULL AND vh IS NOT NULL GROUP BY ALL")
def src12_13(spark, sf):
    """Both bands must be there: on wide rows that is a filter, no join."""
    return cells(spark, sf).where("vv IS NOT NULL AND vh IS NOT NULL").groupBy("scene_id", "row", "col").agg(F.count("*").alias("n"))


@query("src17_26_store_months", "SELECT DISTINCT zarr_path, month FROM {B} WHERE zarr_path IS NOT NULL")
def src17_26(spark, sf):
    return catalog(spark, sf).where("zarr_path IS NOT NULL").select("zarr_path", "month").distinct()


@query("src24_lru_prune", "SELECT doc_id, running FROM (SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents) WHERE running <= 200000")
def src24(spark, sf):
    """What stays of each cache under its size, most recently used first: a running sum."""
    w = Window.partitionBy("source").orderBy(F.col("doc_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "documents").select("doc_id", "source", "n_chars").withColumn("running", F.sum("n_chars").over(w)).where("running <= 200000").select("doc_id", "running")


@query("flt1_flight_direction", "SELECT opera_id FROM {A} WHERE orbit_pass = 'ASCENDING'")
def flt1(spark, sf):
    return acquisitions(spark, sf).where(F.col("orbit_pass") == "ascending".upper()).select("opera_id")


@query("flt2_url_pairs", "SELECT opera_id FROM {A} WHERE url_copol IS NOT NULL AND url_copol <> '' AND url_crosspol IS NOT NULL AND url_crosspol <> ''")
def flt2(spark, sf):
    return acquisitions(spark, sf).where("url_copol <> '' AND url_crosspol <> ''").select("opera_id")


@query("flt3_polarization", "SELECT polarizations, count(*) AS n FROM {A} WHERE polarizations IN ('VV+VH', 'HH+HV') GROUP BY ALL")
def flt3(spark, sf):
    return acquisitions(spark, sf).where(F.col("polarizations").isin("HH+HV", "VV+VH")).groupBy("polarizations").agg(F.count("*").alias("n"))


@query("flt4_url_by_suffix", "SELECT opera_id, CASE WHEN len(u) = 1 THEN u[1] END AS url FROM (SELECT opera_id, list_filter([coalesce(url_copol, ''), coalesce(url_crosspol, '')], lambda x: ends_with(x, '_VH.tif')) AS u FROM {A})")
def flt4(spark, sf):
    u = F.filter(F.array(F.coalesce("url_copol", F.lit("")), F.coalesce("url_crosspol", F.lit(""))), lambda x: x.endswith("_VH.tif"))
    return acquisitions(spark, sf).withColumn("u", u).select("opera_id", F.when(F.size("u") == 1, F.element_at("u", 1)).alias("url"))


@query("flt5_complete_records", "SELECT item_id FROM {B} WHERE status = 'complete' AND schema_version = 8 AND grid_id IS NOT NULL")
def flt5(spark, sf):
    return catalog(spark, sf).where("status = 'complete' AND schema_version = 8 AND grid_id IS NOT NULL").select("item_id")


@query("flt6_7_cube_query", "SELECT item_id, month FROM {B} WHERE tile_id IN ('NATION_1', 'NATION_4') AND upper(flight_direction) = 'ASCENDING' AND datetime >= TIMESTAMP '1996-03-01' AND datetime < TIMESTAMP '1999-06-30' + INTERVAL 1 DAY")
def flt6_7(spark, sf):
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    b = catalog(spark, sf).where(F.col("tile_id").isin("NATION_1", "NATION_4") & (F.upper("flight_direction") == "ASCENDING"))
    after = F.timestamp_add("DAY", F.lit(1), ts("1999-06-30"))  # the end day counts as a whole
    return b.where((F.col("datetime") >= ts("1996-03-01")) & (F.col("datetime") < after)).select("item_id", "month")


@query("flt8_bbox_overlap", "SELECT s_suppkey FROM supplier WHERE s_acctbal <= 3000 AND s_acctbal + 500 >= 1000 AND s_nationkey <= 12 AND s_nationkey + 2 >= 4")
def flt8(spark, sf):
    a = {"xmin": F.col("s_acctbal"), "xmax": F.col("s_acctbal") + 500, "ymin": F.col("s_nationkey"), "ymax": F.col("s_nationkey") + 2}
    b = {k: F.lit(v) for k, v in {"xmin": 1000, "xmax": 3000, "ymin": 4, "ymax": 12}.items()}
    return table(spark, sf, "supplier").where(joins.overlaps(a, b)).select("s_suppkey")


@query("flt9_time_range_scalar", "SELECT item_id FROM {B} WHERE datetime >= TIMESTAMP '2000-01-01'")
def flt9(spark, sf):
    return catalog(spark, sf).where(F.col("datetime") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("item_id")


@query("flt10_items_page", "SELECT item_id, month FROM {B} WHERE product_type = '2-HIGH' AND month BETWEEN '1996-01' AND '1998-12' ORDER BY datetime, item_id LIMIT 50 OFFSET 25")
def flt10(spark, sf):
    b = catalog(spark, sf).where("product_type = '2-HIGH' AND month BETWEEN '1996-01' AND '1998-12'")
    return b.orderBy("datetime", "item_id").offset(25).limit(50).select("item_id", "month")


@query("flt10_months_of_items", "SELECT month, count(*) AS n FROM {B} WHERE product_type = '2-HIGH' AND month BETWEEN '1996-01' AND '1998-12' GROUP BY ALL")
def flt10_months(spark, sf):
    """The months of all items that the filters leave, of which flt10_items_page shows a page."""
    return catalog(spark, sf).where("product_type = '2-HIGH' AND month BETWEEN '1996-01' AND '1998-12'").groupBy("month").agg(F.count("*").alias("n"))


@query("flt11_catalog_filters", "SELECT item_id FROM {B} WHERE coalesce(flight_direction, '') = '' AND coalesce(status, '') = 'complete'")
def flt11(spark, sf):
    want = {"flight_direction": "", "status": "complete"}
    b = catalog(spark, sf)
    for column, value in want.items():
        b = b.where(F.coalesce(column, F.lit("")) == value)
    return b.select("item_id")


@query("flt15_valid_scene_semi", "SELECT scene_id, seq FROM {C} WHERE scene_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def flt15(spark, sf):
    good = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("scene_id"))
    return joins.semi_on_keys(cells(spark, sf), good, ["scene_id"]).select("scene_id", "seq")


@query("flt16_18_drop_missing", "SELECT DISTINCT tile_id, zarr_path FROM {B} WHERE zarr_path IS NOT NULL AND flight_direction IS NOT NULL")
def flt16_18(spark, sf):
    return catalog(spark, sf).dropna(subset=["zarr_path", "flight_direction"]).select("tile_id", "zarr_path").distinct()


@query("flt17_tracks_of_stores", "SELECT burst, mgrs_tile_id FROM {L} WHERE burst % 7 IN (SELECT DISTINCT CAST(regexp_extract(zarr_path, '_TK([0-9]+)', 1) AS BIGINT) FROM {B} WHERE zarr_path IS NOT NULL)")
def flt17(spark, sf):
    tracks = catalog(spark, sf).where("zarr_path IS NOT NULL").select(F.regexp_extract("zarr_path", "_TK([0-9]+)", 1).cast("long").alias("track")).distinct()
    return burst_lut(spark, sf).withColumn("track", F.col("burst") % 7).join(tracks, "track", "left_semi").select("burst", "mgrs_tile_id")


@query("flt19_point_candidates", "SELECT s_suppkey, CAST(floor((9000 - s_acctbal) / 30) AS BIGINT) AS row, CAST(floor((s_nationkey * 40.0 - 100) / 30) AS BIGINT) AS col FROM supplier WHERE floor((9000 - s_acctbal) / 30) BETWEEN 0 AND 199 AND floor((s_nationkey * 40.0 - 100) / 30) BETWEEN 0 AND 19")
def flt19(spark, sf):
    """Inverse affine with floor, then the bounds."""
    row, col = F.floor((9000 - F.col("s_acctbal")) / 30), F.floor((F.col("s_nationkey") * 40.0 - 100) / 30)
    return table(spark, sf, "supplier").select("s_suppkey", row.alias("row"), col.alias("col")).where("row BETWEEN 0 AND 199 AND col BETWEEN 0 AND 19")


@query("flt20_22_resume_anti_join", "SELECT DISTINCT tile_id, month FROM {B} b WHERE NOT EXISTS (SELECT 1 FROM {B} d WHERE d.status = 'partial' AND d.tile_id = b.tile_id AND d.month = b.month)")
def flt20_22(spark, sf):
    b = catalog(spark, sf)
    return b.select("tile_id", "month").distinct().join(b.where("status = 'partial'").select("tile_id", "month"), ["tile_id", "month"], "left_anti")


@query("flt23_time_window", "SELECT scene_id, seq FROM {C} WHERE t BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'")
def flt23(spark, sf):
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    return cells(spark, sf).where(F.col("t").between(ts("1997-01-01"), ts("1997-06-30"))).select("scene_id", "seq")


@query("flt25_viewport_antimeridian", "SELECT s_suppkey FROM supplier WHERE (s_acctbal / 30 BETWEEN 170 AND 180 OR s_acctbal / 30 BETWEEN -180 AND 60) AND s_nationkey BETWEEN 2 AND 20 ORDER BY s_suppkey LIMIT 200")
def flt25(spark, sf):
    """A box whose west is east of its east is two boxes."""
    west, east, lon = 170.0, 60.0, F.col("s_acctbal") / 30
    inside = lon.between(west, east) if west <= east else lon.between(west, 180) | lon.between(-180, east)
    return table(spark, sf, "supplier").where(inside & F.col("s_nationkey").between(2, 20)).orderBy("s_suppkey").limit(200).select("s_suppkey")


@query("join1_append_pass_data", "SELECT opera_id, mgrs_tile_id, acq_group_id, CAST(floor(epoch(acq_dt - TIMESTAMP '2014-01-01') / 518400) AS BIGINT) AS pass_id FROM {A} a JOIN {L} l USING (burst)")
def join1(spark, sf):
    """The lookup table has a row a burst and tile: reference data of a size known from its grid."""
    j = acquisitions(spark, sf).join(F.broadcast(burst_lut(spark, sf)), "burst")
    seconds = F.timestamp_diff("SECOND", F.lit("2014-01-01").cast("timestamp_ntz"), F.col("acq_dt"))
    return j.select("opera_id", "mgrs_tile_id", "acq_group_id", F.floor(seconds / 518400).alias("pass_id"))


@query("join2_bursts_left_lut", "SELECT n.n_nationkey AS burst, l.mgrs_tile_id FROM nation n LEFT JOIN {L} l ON n.n_nationkey = l.burst")
def join2(spark, sf):
    b = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("burst"))
    return b.join(burst_lut(spark, sf), "burst", "left").select(F.col("burst").cast("int").alias("burst"), "mgrs_tile_id")


@query("join3_pre_match_post_keys", "SELECT opera_id FROM {A} a WHERE acq_dt < TIMESTAMP '2024-01-15' AND EXISTS (SELECT 1 FROM {A} p WHERE p.acq_dt >= TIMESTAMP '2024-01-15' AND p.jpl_burst_id = a.jpl_burst_id AND p.polarizations = a.polarizations)")
def join3(spark, sf):
    a = acquisitions(spark, sf)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return joins.semi_on_keys(a.where(F.col("acq_dt") < cut), a.where(F.col("acq_dt") >= cut), ["jpl_burst_id", "polarizations"]).select("opera_id")


@query("join4_time_window_join", "SELECT p.opera_id AS post_id, count(*) AS n_pre, max(h.acq_dt) AS last_pre FROM {A} p JOIN {A} h ON p.jpl_burst_id = h.jpl_burst_id AND h.acq_dt >= p.acq_dt - INTERVAL 6 DAY AND h.acq_dt < p.acq_dt - INTERVAL 1 DAY GROUP BY ALL")
def join4(spark, sf):
    """Histories of acquisitions from six days to one day before each post image."""
    a = acquisitions(spark, sf)
    post = a.select(F.col("opera_id").alias("post_id"), "jpl_burst_id", F.col("acq_dt").alias("post_dt"))
    found = joins.window_stats(post, a.select("jpl_burst_id", "acq_dt"), ["jpl_burst_id"], "post_dt", "acq_dt", 1, 6, ["post_id"])
    return found.select("post_id", F.col("n").alias("n_pre"), F.col("last").alias("last_pre"))


@query("join5_burst_intersection", "SELECT DISTINCT burst FROM {A} WHERE event_id % 2 = 0 INTERSECT SELECT DISTINCT burst FROM {A} WHERE event_id % 3 = 0")
def join5(spark, sf):
    a = acquisitions(spark, sf)
    return a.where("event_id % 2 = 0").select("burst").intersect(a.where("event_id % 3 = 0").select("burst"))


@query("join6_normalised_key", "SELECT count(*) AS n FROM {A} a JOIN (SELECT DISTINCT upper(replace(lower(replace(jpl_burst_id, '-', '_')), '-', '_')) AS k FROM {A}) s ON upper(replace(a.jpl_burst_id, '-', '_')) = s.k")
def join6(spark, sf):
    a = acquisitions(spark, sf).withColumn("k", F.upper(F.translate("jpl_burst_id", "-", "_")))
    other = a.select(F.upper(F.translate(F.lower(F.translate("jpl_burst_id", "-", "_")), "-", "_")).alias("k")).distinct()
    return a.join(other, "k").agg(F.count("*").alias("n"))


@query("join7_track_lookup", "WITH s AS (SELECT date_trunc('second', ts) AS sec, min(user_id % 7) AS track FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT e.event_id, coalesce(c.c_nationkey, s.track, -1) AS track FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id * 11 LEFT JOIN s ON s.sec = date_trunc('second', e.ts)")
def join7(spark, sf):
    """The track by the row's id, else by its second in UTC, else -1: two keyed lookups, each of a row a key."""
    e = table(spark, sf, "events")
    second = lambda c: F.date_trunc("second", c).cast("timestamp_ntz")
    by_id = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("by_id"))
    by_second = e.where("event_type = 'click'").groupBy(second("ts").alias("sec")).agg(F.min(F.col("user_id") % 7).alias("by_second"))
    found = e.select("event_id", (F.col("user_id") * 11).alias("k"), second("ts").alias("sec")).join(by_id, "k", "left").join(by_second, "sec", "left")
    return found.select("event_id", F.coalesce("by_id", "by_second", F.lit(-1)).alias("track"))


@query("join8_majority_grid", "WITH v AS (SELECT tile_id, grid_id, count(*) AS n FROM {B} WHERE grid_id IS NOT NULL GROUP BY ALL), m AS (SELECT tile_id, grid_id FROM v QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY n DESC, grid_id) = 1) SELECT tile_id, grid_id, count(*) AS n_items, count(DISTINCT processing_signature) AS n_signatures FROM {B} JOIN m USING (tile_id, grid_id) GROUP BY ALL")
def join8(spark, sf):
    b = catalog(spark, sf)
    kept = b.join(joins.majority(b, "tile_id", "grid_id"), ["tile_id", "grid_id"], "left_semi")
    return kept.groupBy("tile_id", "grid_id").agg(F.count("*").alias("n_items"), F.count_distinct("processing_signature").alias("n_signatures"))


@query("join9_10_dynamic_static", "WITH s AS (SELECT p_partkey % 8 AS row, p_size % 6 AS col, min(p_retailprice) AS dem FROM part GROUP BY ALL) SELECT c.scene_id, c.seq, s.dem FROM {C} c LEFT JOIN s ON c.row = s.row AND c.col = s.col")
def join9_10(spark, sf):
    """Static layers join on lattice places; they are never repeated over time."""
    part = table(spark, sf, "part")
    row, col = joins.lattice_index((F.col("p_partkey") % 8) * 30.0 + 100, 100.0, 30.0), joins.lattice_index((F.col("p_size") % 6) * 30.0 - 60, -60.0, 30.0)
    static = part.groupBy(row.alias("row"), col.alias("col")).agg(F.min("p_retailprice").alias("dem"))
    return cells(spark, sf).join(static, ["row", "col"], "left").select("scene_id", "seq", "dem")


@query("join11_points_in_grids", "WITH g AS (SELECT s_suppkey, s_acctbal AS xmin, s_acctbal + 400 AS xmax, s_nationkey * 1.0 AS ymin, s_nationkey + 3.0 AS ymax FROM supplier) SELECT c_custkey, s_suppkey FROM customer JOIN g ON c_acctbal >= xmin AND c_acctbal < xmax AND c_nationkey >= ymin AND c_nationkey < ymax")
def join11(spark, sf):
    return joins.points_in_rectangles(*_points_and_grids(spark, sf), (128.0, 1.0)).select("c_custkey", "s_suppkey")


def _points_and_grids(spark, sf):
    g = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("xmin"), (F.col("s_acctbal") + 400).alias("xmax"), F.col("s_nationkey").cast("double").alias("ymin"), (F.col("s_nationkey") + 3.0).alias("ymax"))
    return table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y")), g


@query("join12_13_first_tile_of_point", "WITH g AS (SELECT s_suppkey, s_acctbal AS xmin, s_acctbal + 400 AS xmax, s_nationkey * 1.0 AS ymin, s_nationkey + 3.0 AS ymax FROM supplier) SELECT c_custkey, min(s_suppkey) AS tile FROM customer JOIN g ON c_acctbal >= xmin AND c_acctbal < xmax AND c_nationkey >= ymin AND c_nationkey < ymax GROUP BY ALL")
def join12_13(spark, sf):
    return joins.first_rectangle(*_points_and_grids(spark, sf), (128.0, 1.0), ["c_custkey"], "s_suppkey").withColumnRenamed("s_suppkey", "tile")


@query("join14_siblings", "WITH o AS (SELECT tile_id, geometry_group_id, product_type, item_id FROM {B} QUALIFY row_number() OVER (PARTITION BY tile_id, geometry_group_id, product_type ORDER BY item_id) = 1) SELECT a.item_id, b.product_type AS sibling_type, b.item_id AS sibling_id FROM o a JOIN o b ON a.tile_id = b.tile_id AND a.geometry_group_id = b.geometry_group_id AND a.product_type <> b.product_type")
def join14(spark, sf):
    b = catalog(spark, sf).select("tile_id", "geometry_group_id", "product_type", "item_id")
    s = joins.siblings(b, ["tile_id", "geometry_group_id"], "product_type", [F.col("item_id")])
    return s.select("item_id", F.col("sibling_product_type").alias("sibling_type"), F.col("sibling_item_id").alias("sibling_id"))


@query("join15_virtual_stack", "SELECT item_id, grid_id IS NOT DISTINCT FROM 'g2' AS same_grid FROM {B} WHERE tile_id = 'NATION_6'")
def join15(spark, sf):
    return catalog(spark, sf).where("tile_id = 'NATION_6'").select("item_id", F.col("grid_id").eqNullSafe("g2").alias("same_grid"))


@query("join16_static_match_check", "WITH s AS (SELECT n_name AS tile_id, n_regionkey % 4 AS geometry_group_id FROM nation) SELECT d.tile_id, d.geometry_group_id, count(s.tile_id) AS matches FROM (SELECT DISTINCT tile_id, geometry_group_id FROM {B}) d LEFT JOIN s ON s.tile_id = d.tile_id AND s.geometry_group_id = d.geometry_group_id GROUP BY ALL HAVING count(s.tile_id) <> 1")
def join16(spark, sf):
    s = table(spark, sf, "nation").select(F.col("n_name").alias("tile_id"), (F.col("n_regionkey") % 4).cast("long").alias("geometry_group_id"), F.lit(1).alias("hit"))
    d = catalog(spark, sf).select("tile_id", "geometry_group_id").distinct()
    return d.join(s, ["tile_id", "geometry_group_id"], "left").groupBy("tile_id", "geometry_group_id").agg(F.count("hit").alias("matches")).where("matches <> 1")


@query("join17_bursts_of_tiles", "SELECT burst, min(mgrs_tile_id) AS tile FROM {L} WHERE mgrs_tile_id IN ('NATION_3', 'NATION_4', 'NATION_5') GROUP BY ALL")
def join17(spark, sf):
    return burst_lut(spark, sf).where(F.col("mgrs_tile_id").isin("NATION_3", "NATION_4", "NATION_5")).groupBy("burst").agg(F.min("mgrs_tile_id").alias("tile"))


@query("join18_catalog_map", "SELECT t.tile_id, t.n, n.n_regionkey FROM (SELECT CASE WHEN item_id % 40 = 0 THEN 'LOST' ELSE tile_id END AS tile_id, count(*) AS n FROM {B} GROUP BY ALL) t LEFT JOIN nation n ON t.tile_id = n.n_name")
def join18(spark, sf):
    t = catalog(spark, sf).groupBy(F.when(F.col("item_id") % 40 == 0, "LOST").otherwise(F.col("tile_id")).alias("tile_id")).agg(F.count("*").alias("n"))
    n = table(spark, sf, "nation").select(F.col("n_name").alias("tile_id"), "n_regionkey")
    return t.join(n, "tile_id", "left").select("tile_id", "n", "n_regionkey")


@query("join19_coverage_merge", "WITH c AS (SELECT tile_id, month, count(*) AS n FROM {B} WHERE item_id % 3 = 0 GROUP BY ALL), s AS (SELECT tile_id, month, count(DISTINCT zarr_path) AS n FROM {B} WHERE item_id % 5 = 0 GROUP BY ALL) SELECT coalesce(c.tile_id, s.tile_id) AS tile_id, coalesce(c.month, s.month) AS month, greatest(coalesce(c.n, 0), coalesce(s.n, 0)) AS n, c.n IS NULL AS uncataloged FROM c FULL JOIN s ON c.tile_id = s.tile_id AND c.month = s.month")
def join19(spark, sf):
    b = catalog(spark, sf)
    c = b.where("item_id % 3 = 0").groupBy("tile_id", "month").agg(F.count("*").alias("cn"))
    s = b.where("item_id % 5 = 0").groupBy("tile_id", "month").agg(F.count_distinct("zarr_path").alias("sn"))
    return c.join(s, ["tile_id", "month"], "full_outer").select("tile_id", "month", F.greatest(F.coalesce("cn", F.lit(0)), F.coalesce("sn", F.lit(0))).alias("n"), F.col("cn").isNull().alias("uncataloged"))


@query("join20_link_integrity", "SELECT 'output' AS side, l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0) GROUP BY ALL UNION ALL SELECT 'source', l_suppkey, count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 30 <> 0) GROUP BY ALL")
def join20(spark, sf):
    """Links whose output or source is not there: anti joins, which must be empty in a sound store."""
    li = table(spark, sf, "lineitem")
    out = table(spark, sf, "orders").where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    src = table(spark, sf, "supplier").where("s_suppkey % 30 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    part = lambda name, key, other: li.join(other, key, "left_anti").groupBy(F.lit(name).alias("side"), F.col(key).alias("id")).agg(F.count("*").alias("n"))
    return part("output", "l_orderkey", out).unionByName(part("source", "l_suppkey", src))


@query("join21_band_pairing", "SELECT a.l_orderkey AS scene_id, a.l_linenumber AS seq, a.l_quantity AS vv, b.l_discount AS vh FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_returnflag = 'A' AND b.l_tax > 0.02")
def join21(spark, sf):
    li = table(spark, sf, "lineitem")
    vv = li.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("vv"))
    vh = li.where("l_tax > 0.02").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("vh"))
    return vv.join(vh, ["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("seq"), "vv", "vh")


@query("join22_created_at_kept", "WITH o AS (SELECT tile_id, product_type, zarr_path, min(datetime) AS created FROM {B} WHERE item_id % 2 = 0 AND zarr_path IS NOT NULL GROUP BY ALL), n AS (SELECT tile_id, product_type, zarr_path, max(datetime) AS now FROM {B} WHERE zarr_path IS NOT NULL GROUP BY ALL) SELECT n.tile_id, n.product_type, n.zarr_path, coalesce(o.created, n.now) AS created_at FROM n LEFT JOIN o ON n.tile_id = o.tile_id AND n.product_type = o.product_type AND n.zarr_path = o.zarr_path")
def join22(spark, sf):
    keys = ["tile_id", "product_type", "zarr_path"]
    b = catalog(spark, sf).where("zarr_path IS NOT NULL")
    old = b.where("item_id % 2 = 0").groupBy(*keys).agg(F.min("datetime").alias("created"))
    new = b.groupBy(*keys).agg(F.max("datetime").alias("now"))
    return new.join(old, keys, "left").select(*keys, F.coalesce("created", "now").alias("created_at"))


@query("join23_missing_assets", "SELECT e.tile_id, e.month FROM (SELECT DISTINCT tile_id, month FROM {B}) e LEFT JOIN (SELECT DISTINCT tile_id, month FROM {B} WHERE status = 'complete' AND item_id % 4 = 0) a ON a.tile_id = e.tile_id AND a.month = e.month WHERE a.tile_id IS NULL")
def join23(spark, sf):
    b = catalog(spark, sf)
    have = b.where("status = 'complete' AND item_id % 4 = 0").select("tile_id", "month")
    return b.select("tile_id", "month").distinct().join(have, ["tile_id", "month"], "left_anti")


@query("join24_grid_adoption", "SELECT tile_id, max_by(grid_id, (n, grid_id)) AS grid_id FROM (SELECT tile_id, grid_id, count(DISTINCT month) AS n FROM {B} WHERE grid_id IS NOT NULL GROUP BY ALL) GROUP BY ALL")
def join24(spark, sf):
    """Most time steps win; the largest key on a tie."""
    n = catalog(spark, sf).where("grid_id IS NOT NULL").groupBy("tile_id", "grid_id").agg(F.count_distinct("month").alias("n"))
    return n.groupBy("tile_id").agg(F.max_by("grid_id", F.struct("n", "grid_id")).alias("grid_id"))


@query("join25_token_tracks", "SELECT s.s_suppkey, t.part AS track FROM supplier s JOIN (SELECT unnest(string_split('1_3_5_8', '_')) AS part) t ON CAST(t.part AS BIGINT) = s.s_suppkey % 10")
def join25(spark, sf):
    token = spark.range(1).select(F.explode(F.split(F.lit("1_3_5_8"), "_")).alias("track"))
    return table(spark, sf, "supplier").withColumn("k", F.col("s_suppkey") % 10).join(token.withColumn("k", F.col("track").cast("long")), "k").select("s_suppkey", "track")


@query("win1_pass_min", "SELECT opera_id, min(acq_dt) OVER (PARTITION BY burst, orbit_pass) AS first_dt FROM {A}")
def win1(spark, sf):
    """The least time a pass is a grouped aggregate joined back: no window gathers a pass, and the rows stay where they are
    if the groups are few."""
    a = acquisitions(spark, sf).select("opera_id", "burst", "orbit_pass", "acq_dt")
    first = a.groupBy("burst", "orbit_pass").agg(F.min("acq_dt").alias("first_dt"))
    return a.join(first, ["burst", "orbit_pass"]).select("opera_id", "first_dt")


@query("win2_latest_per_burst", "SELECT opera_id, jpl_burst_id FROM {A} QUALIFY row_number() OVER (PARTITION BY jpl_burst_id ORDER BY acq_dt DESC, opera_id) <= 3")
def win2(spark, sf):
    return top_n(acquisitions(spark, sf), ["jpl_burst_id"], [F.col("acq_dt").desc(), F.col("opera_id")], 3).select("opera_id", "jpl_burst_id")


@query("win3_first_non_null", "SELECT jpl_burst_id, arg_min(url_copol, event_id) FILTER (url_copol IS NOT NULL) AS url, arg_min(polarizations, event_id) AS pol FROM {A} GROUP BY ALL")
def win3(spark, sf):
    """pandas' first: the first non-null of each column by itself."""
    a = acquisitions(spark, sf)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("event_id")))
    return a.groupBy("jpl_burst_id").agg(first("url_copol").alias("url"), first("polarizations").alias("pol"))


@query("win4_keep_last", "SELECT jpl_burst_id, orbit_pass, opera_id FROM {A} QUALIFY row_number() OVER (PARTITION BY jpl_burst_id, orbit_pass ORDER BY acq_dt DESC, event_id DESC) = 1")
def win4(spark, sf):
    return pick(acquisitions(spark, sf), ["jpl_burst_id", "orbit_pass"], ["opera_id"], F.struct("acq_dt", "event_id"), last=True)


@query("win5_keep_first", "SELECT jpl_burst_id, orbit_pass, opera_id FROM {A} QUALIFY row_number() OVER (PARTITION BY jpl_burst_id, orbit_pass ORDER BY acq_dt, event_id) = 1")
def win5(spark, sf):
    return pick(acquisitions(spark, sf), ["jpl_burst_id", "orbit_pass"], ["opera_id"], F.struct("acq_dt", "event_id"))


@query("win6_max_id_per_burst", "SELECT jpl_burst_id, max(opera_id) AS opera_id, arg_max(acq_dt, opera_id) AS acq_dt FROM {A} GROUP BY ALL")
def win6(spark, sf):
    return pick(acquisitions(spark, sf), ["jpl_burst_id"], ["opera_id", "acq_dt"], F.col("opera_id"), last=True)


@query("win7_tolerance_window", "SELECT opera_id FROM {A} WHERE acq_dt > (SELECT max(acq_dt) FROM {A}) - INTERVAL 3 DAY")
def win7(spark, sf):
    """The bound is a one-row aggregate, broadcast; no global window."""
    a = acquisitions(spark, sf)
    bound = a.agg(F.timestamp_add("DAY", F.lit(-3), F.max("acq_dt")).alias("bound"))
    return a.join(F.broadcast(bound), F.col("acq_dt") > F.col("bound")).select("opera_id")


@query("win8_track_priority", "SELECT month, track, row_number() OVER (PARTITION BY month ORDER BY n DESC, track) AS priority FROM (SELECT month, track, count(DISTINCT row * 6 + col) AS n FROM {C} WHERE vv > 0 GROUP BY ALL)")
def win8(spark, sf):
    from gridloom.operators.composite import composite, track_order

    o = track_order(composite(cells(spark, sf), ["month", "row", "col", "track"], "min"))
    return o.select("month", "track", F.col("priority").cast("long").alias("priority"))


@query("win12_single_track", "SELECT row, col, track, n FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, track) AS k FROM (SELECT row, col, track, count(*) AS n FROM {C} WHERE vv IS NOT NULL AND vh IS NOT NULL GROUP BY ALL)) WHERE k = 1")
def win12(spark, sf):
    n = cells(spark, sf).where("vv IS NOT NULL AND vh IS NOT NULL").groupBy("row", "col", "track").agg(F.count("*").alias("n"))
    return top_n(n, ["row", "col"], [F.col("n").desc(), F.col("track")])


@query("win13_representative_time", "SELECT tile_id, month, list_sort(list(datetime))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS t FROM {B} GROUP BY ALL")
def win13(spark, sf):
    """The upper median: element n div 2 of the sorted times of a month and tile."""
    b = catalog(spark, sf).select("tile_id", "month", "datetime", "item_id")
    w = Window.partitionBy("tile_id", "month")
    r = b.withColumn("k", F.row_number().over(w.orderBy("datetime", "item_id"))).withColumn("n", F.count("*").over(w))
    return r.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select("tile_id", "month", F.col("datetime").alias("t"))


@query("win14_monotonicity", "SELECT conv_id, min(turn) AS first_disorder FROM (SELECT conv_id, turn, length(text) AS t, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE t < p GROUP BY ALL")
def win14(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("t"))
    p = F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("p", p).where("t < p").groupBy("conv_id").agg(F.min("turn").alias("first_disorder"))


@query("win15_product_numbering", "WITH g AS (SELECT track_number, burst, orbit_pass, count(*) AS n FROM {A} GROUP BY ALL HAVING count(*) > 30) SELECT track_number, burst, orbit_pass, n, row_number() OVER (ORDER BY track_number, burst, orbit_pass DESC) - 1 AS product_id FROM g")
def win15(spark, sf):
    """Ids run over non-empty products: a track's offset is the running sum of the counts a track, a row each, and places
    inside a track come from its own partition."""
    g = acquisitions(spark, sf).groupBy("track_number", "burst", "orbit_pass").agg(F.count("*").alias("n")).where("n > 30")
    per = g.groupBy("track_number").agg(F.count("*").alias("c"))
    run = Window.partitionBy(F.lit(0)).orderBy("track_number").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("track_number", F.coalesce(F.sum("c").over(run), F.lit(0)).alias("before"))
    k = F.row_number().over(Window.partitionBy("track_number").orderBy("burst", F.col("orbit_pass").desc()))
    return g.withColumn("k", k).join(before, "track_number").select("track_number", "burst", "orbit_pass", "n", (F.col("before") + F.col("k") - 1).alias("product_id"))


@query("win17_outliers", "WITH q AS (SELECT track, quantile_cont(vv, 0.25) AS q1, quantile_cont(vv, 0.75) AS q3, avg(vv) AS m, stddev_pop(vv) AS s FROM {C} GROUP BY ALL) SELECT track, count(*) FILTER (vv < q1 - 0.2 * (q3 - q1) OR vv > q3 + 0.2 * (q3 - q1)) AS iqr_out, count(*) FILTER (abs(vv - m) / s > 1.5) AS z_out FROM {C} JOIN q USING (track) GROUP BY ALL")
def win17(spark, sf):
    """Bounds are a grouped aggregate joined back: no window holds a whole series."""
    c = cells(spark, sf)
    q = c.groupBy("track").agg(F.percentile("vv", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.avg("vv").alias("m"), F.stddev_pop("vv").alias("s"))
    spread = 0.2 * (F.col("q")[1] - F.col("q")[0])
    out = (F.col("vv") < F.col("q")[0] - spread) | (F.col("vv") > F.col("q")[1] + spread)
    return c.join(F.broadcast(q), "track").groupBy("track").agg(F.count_if(out).alias("iqr_out"), F.count_if(F.abs(F.col("vv") - F.col("m")) / F.col("s") > 1.5).alias("z_out"))


@query("win20_interior_gap", "WITH p AS (SELECT DISTINCT track_number, CAST(acq_dt AS DATE) AS day, burst FROM {A}), f AS (SELECT DISTINCT track_number, burst FROM p), e AS (SELECT track_number, day, min(burst) AS lo, max(burst) AS hi FROM p GROUP BY ALL) SELECT e.track_number, e.day, f.burst FROM e JOIN f ON f.track_number = e.track_number AND f.burst > lo AND f.burst < hi ANTI JOIN p ON p.track_number = e.track_number AND p.day = e.day AND p.burst = f.burst")
def win20(spark, sf):
    """Bursts of a track's footprint between the first and last one that a day's pass has and that it lacks itself: sets
    a track and pass, which the number of bursts bounds."""
    p = acquisitions(spark, sf).select("track_number", F.to_date("acq_dt").alias("day"), "burst")
    foot = p.groupBy("track_number").agg(F.collect_set("burst").alias("foot"))
    present = p.groupBy("track_number", "day").agg(F.collect_set("burst").alias("present"))
    inside = F.filter(F.array_except("foot", "present"), lambda b: (b > F.array_min("present")) & (b < F.array_max("present")))
    return present.join(F.broadcast(foot), "track_number").select("track_number", "day", F.explode(inside).alias("burst"))


@query("srt1_sorted_catalog", "SELECT item_id, tile_id, flight_direction FROM {B} ORDER BY tile_id, flight_direction NULLS LAST, datetime, item_id")
def srt1(spark, sf):
    b = catalog(spark, sf)
    return b.orderBy("tile_id", F.col("flight_direction").asc_nulls_last(), "datetime", "item_id").select("item_id", "tile_id", "flight_direction")


BANDS = ("VV", "VH", "HH", "HV", "Ratio", "RVI")


@query("srt2_band_order", "SELECT part AS item, string_agg(band, ',' ORDER BY CASE band WHEN 'VV' THEN 0 WHEN 'VH' THEN 1 WHEN 'HH' THEN 2 WHEN 'HV' THEN 3 WHEN 'Ratio' THEN 4 WHEN 'RVI' THEN 5 ELSE 6 END, band) AS bands FROM (SELECT DISTINCT p_size AS part, ['RVI', 'VV', 'Zeta', 'VH', 'Alpha', 'HV', 'Ratio'][CAST(1 + p_partkey % 7 AS BIGINT)] AS band FROM part) GROUP BY ALL")
def srt2(spark, sf):
    """Canonical order: the known bands first, the rest by name."""
    band = F.element_at(F.array(*map(F.lit, ("RVI", "VV", "Zeta", "VH", "Alpha", "HV", "Ratio"))), (1 + F.col("p_partkey") % 7).cast("int"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, BANDS)), band), F.lit(0)), F.lit(len(BANDS) + 1))
    got = table(spark, sf, "part").groupBy(F.col("p_size").alias("item")).agg(F.array_sort(F.collect_set(F.struct(place.alias("k"), band.alias("b")))).alias("x"))
    return got.select("item", F.array_join(F.transform("x", lambda s: s["b"]), ",").alias("bands"))


@query("srt3_4_pagination_head", "SELECT item_id FROM {B} ORDER BY datetime DESC, item_id LIMIT 100 OFFSET 400")
def srt3_4(spark, sf):
    return catalog(spark, sf).orderBy(F.col("datetime").desc(), "item_id").offset(400).limit(100).select("item_id")


@query("srt5_majority_value", "SELECT grid_id FROM {B} WHERE grid_id IS NOT NULL GROUP BY grid_id ORDER BY count(*) DESC, grid_id LIMIT 1")
def srt5(spark, sf):
    n = catalog(spark, sf).where("grid_id IS NOT NULL").groupBy("grid_id").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "grid_id").limit(1).select("grid_id")


@query("srt6_grid_top", "SELECT tile_id, grid_id FROM (SELECT tile_id, grid_id, row_number() OVER (PARTITION BY tile_id ORDER BY s DESC, grid_id DESC) AS k FROM (SELECT tile_id, grid_id, sum(size) AS s FROM {B} WHERE grid_id IS NOT NULL GROUP BY ALL)) WHERE k = 1")
def srt6(spark, sf):
    s = catalog(spark, sf).where("grid_id IS NOT NULL").groupBy("tile_id", "grid_id").agg(F.sum("size").alias("s"))
    return s.groupBy("tile_id").agg(F.max_by("grid_id", F.struct("s", "grid_id")).alias("grid_id"))


@query("smp2_3_subsample_split", "WITH p AS (SELECT doc_id FROM labels WHERE quality = 1), u AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42|' || doc_id), doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p)) SELECT doc_id, 1 AS s, substr(sha256('7|' || doc_id), 1, 1) IN ('0', '1', '2') AS held_out FROM p UNION ALL SELECT doc_id, 0, false FROM u WHERE k <= 3 * (SELECT count(*) FROM p)")
def smp2_3(spark, sf):
    """Unlabelled rows down to three times the positives, and a held-out part of the positives, by keyed hash."""
    pos = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    rest = least_hashed(table(spark, sf, "documents").select("doc_id").join(pos, "doc_id", "left_anti"), ["doc_id"], 3 * pos.count(), 42)
    held = F.substring(keyed_hash(["doc_id"], 7), 1, 1).isin("0", "1", "2")
    return pos.select("doc_id", F.lit(1).alias("s"), held.alias("held_out")).unionByName(rest.select("doc_id", F.lit(0).alias("s"), F.lit(False).alias("held_out")))


@query("smp4_strided_sample", "SELECT scene_id, seq FROM {C} WHERE row % 4 < 1 AND col % 3 < 1")
def smp4(spark, sf):
    return cells(spark, sf).where("pmod(row, 4) < 1 AND pmod(col, 3) < 1").select("scene_id", "seq")


#: Rows that a rank correlation takes at most.
CORRELATION_ROWS = 2_000_000


@query("smp5_capped_sample", f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (ORDER BY sha256('42|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= {CORRELATION_ROWS}")
def smp5(spark, sf):
    """A reproducible sample of a capped size: the least keyed hashes."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return least_hashed(li, ["l_orderkey", "l_linenumber"], CORRELATION_ROWS, 42)


@query("set1_union_missing_columns", "SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def set1(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("set2_footprint_union", "SELECT DISTINCT track_number, jpl_burst_id FROM (SELECT * FROM {A} WHERE event_id % 7 = 0 UNION ALL SELECT * FROM {A} WHERE event_id % 11 = 0)")
def set2(spark, sf):
    a = acquisitions(spark, sf)
    foot = lambda cond: a.where(cond).select("track_number", "jpl_burst_id")
    return foot("event_id % 7 = 0").union(foot("event_id % 11 = 0")).distinct()


@query("set3_band_intersection", "SELECT DISTINCT o_orderpriority AS band FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey % 5 = 1")
def set3(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("band"))
    return o.where("o_orderkey % 2 = 0").select("band").intersect(o.where("o_orderkey % 5 = 1").select("band"))


@query("set4_6_except", "SELECT DISTINCT n_name AS tile FROM nation EXCEPT SELECT DISTINCT tile_id FROM {B} WHERE item_id % 700 = 0")
def set4_6(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("tile")).exceptAll(catalog(spark, sf).where("item_id % 700 = 0").select(F.col("tile_id").alias("tile")).distinct()).distinct()


@query("set5_common_time_axis", "WITH v AS (SELECT row, col, month, track, avg(vv) AS vv FROM {C} GROUP BY ALL) SELECT m.row, m.col, m.month, k.track, round(v.vv, 6) AS vv FROM (SELECT DISTINCT row, col, month FROM v) m JOIN (SELECT DISTINCT row, col, track FROM v) k USING (row, col) LEFT JOIN v ON v.row = m.row AND v.col = m.col AND v.month = m.month AND v.track = k.track")
def set5(spark, sf):
    """In each cell one series a track on the union of the time axes: grouped once, each cell's values meet its axis and tracks."""
    v = cells(spark, sf).groupBy("row", "col", "month", "track").agg(F.avg("vv").alias("vv"))
    one = v.groupBy("row", "col").agg(F.collect_set("month").alias("ms"), F.collect_set("track").alias("ts"), F.map_from_entries(F.collect_list(F.struct(F.struct("month", "track").alias("k"), F.col("vv").alias("v")))).alias("vs"))
    axis = one.select("row", "col", "ts", "vs", F.explode("ms").alias("month")).select("row", "col", "vs", "month", F.explode("ts").alias("track"))
    return axis.select("row", "col", "month", "track", F.round(F.try_element_at("vs", F.struct("month", "track")), 6).alias("vv"))


@query("set7_month_union", "SELECT month FROM {B} WHERE item_id % 3 = 0 UNION SELECT month FROM {C} WHERE row = 0")
def set7(spark, sf):
    return catalog(spark, sf).where("item_id % 3 = 0").select("month").union(cells(spark, sf).where("row = 0").select("month")).distinct()


UPSERT_KEYS = ["tile_id", "flight_direction", "datetime", "product_type", "month"]


@query("snk6_8_catalog_upsert", "WITH u AS (SELECT *, 0 AS gen FROM {B} WHERE item_id % 2 = 0 UNION ALL SELECT *, 1 FROM {B} WHERE item_id % 3 = 0) SELECT item_id, tile_id, month FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, flight_direction, datetime, product_type, month ORDER BY gen DESC, item_id DESC) AS k FROM u) WHERE k = 1")
def snk6_8(spark, sf):
    b = catalog(spark, sf)
    return upsert(b.where("item_id % 2 = 0"), b.where("item_id % 3 = 0"), UPSERT_KEYS, [F.col("item_id").desc()]).select("item_id", "tile_id", "month")


@query("snk9_publish_replace", "SELECT item_id FROM {B} o WHERE item_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM {B} n WHERE n.item_id % 9 = 1 AND n.product_type = o.product_type AND n.zarr_path = o.zarr_path AND n.month = o.month) UNION ALL SELECT item_id FROM {B} WHERE item_id % 9 = 1")
def snk9(spark, sf):
    b = catalog(spark, sf)
    return replace_keys(b.where("item_id % 2 = 0"), b.where("item_id % 9 = 1"), ["product_type", "zarr_path", "month"]).select("item_id")


@query("snk5_delete_month", "SELECT scene_id, seq FROM {C} WHERE month <> '1997-05'")
def snk5(spark, sf):
    """The month's partition goes from the store; nothing else is read or written."""
    from gridloom.sources import sinks
    from gridloom.streaming.cube import scratch

    path = f"{scratch(spark)}/store"
    cells(spark, sf).select("scene_id", "seq", "month").repartition("month").write.partitionBy("month").parquet(path)
    sinks.delete_month(spark, path, "1997-05")
    return spark.read.parquet(path).select("scene_id", "seq")


@query("snk2_append_guard", "SELECT n.t, n.n FROM (SELECT t, count(*) AS n FROM {C} WHERE seq = 1 GROUP BY ALL) n WHERE n.t NOT IN (SELECT t FROM {C} WHERE seq = 2)")
def snk2(spark, sf):
    """New time steps only: those that the store has are refused."""
    c = cells(spark, sf)
    new = c.where("seq = 1").groupBy("t").agg(F.count("*").alias("n"))
    return new.join(c.where("seq = 2").select("t"), "t", "left_anti")


@query("snk13_preview_downsample", "SELECT block_id, CAST(floor(row / 2) AS BIGINT) AS r, CAST(floor(col / 2) AS BIGINT) AS c, round(avg(CAST(v AS DOUBLE)), 5) AS v FROM {D} GROUP BY ALL")
def snk13(spark, sf):
    from gridloom.plans.bind import chunks

    return chunks(spark, sf).groupBy("block_id", F.floor(F.col("row") / 2).alias("r"), F.floor(F.col("col") / 2).alias("c")).agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("v"))


@query("snk14_stac_items", "SELECT item_id, '{\"type\":\"Feature\",\"id\":\"' || item_id || '\",\"properties\":{\"tile\":\"' || tile_id || '\",\"month\":\"' || month || '\"}}' AS item FROM {B}")
def snk14(spark, sf):
    item = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("item_id").cast("string").alias("id"), F.struct(F.col("tile_id").alias("tile"), "month").alias("properties")))
    return catalog(spark, sf).select("item_id", item.alias("item"))


@query("snk17_child_links", "SELECT DISTINCT tile_id AS child FROM {B} WHERE item_id % 2 = 0 UNION SELECT DISTINCT tile_id FROM {B} WHERE item_id % 13 = 0")
def snk17(spark, sf):
    b = catalog(spark, sf)
    return b.where("item_id % 2 = 0").select(F.col("tile_id").alias("child")).union(b.where("item_id % 13 = 0").select("tile_id")).distinct()


@query("snk4_block_casts", "SELECT month, row, col, CAST(coalesce(count(vh), 0) AS SMALLINT) AS n_obs FROM {C} GROUP BY ALL")
def snk4(spark, sf):
    return cells(spark, sf).groupBy("month", "row", "col").agg(F.coalesce(F.count("vh"), F.lit(0)).cast("smallint").alias("n_obs"))
