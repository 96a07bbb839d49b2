"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import names
from gridloom.operators.joins import lattice_index
from gridloom.plans.bind import acquisitions, catalog, chunks, query, table


def _stores(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.concat(F.lit("data/17MPU/s1_"), F.format_string("%04d-%02d", 2015 + F.col("p_partkey") % 9, 1 + F.col("p_partkey") % 12), F.lit("_TK"), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 4).cast("string"), F.lit("_N"), (F.col("p_partkey") % 9).cast("string"), F.lit(".zarr")).alias("path"))


STORES = "(SELECT p_partkey, 'data/17MPU/s1_' || (2015 + p_partkey % 9) || '-' || lpad(CAST(1 + p_partkey % 12 AS VARCHAR), 2, '0') || '_TK' || p_size || '-' || (p_size + 4) || '_N' || (p_partkey % 9) || '.zarr' AS path FROM part)"


@query("scl6_pass_id", "SELECT event_id, CAST(floor(epoch(acq_dt - TIMESTAMP '2014-01-01') / 518400) AS BIGINT) AS pass_id FROM {A}")
def scl6(spark, sf):
    return acquisitions(spark, sf).select("event_id", names.pass_id(F.col("acq_dt")).alias("pass_id"))


@query("scl7_polarization_name", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'VV+VH' WHEN 1 THEN 'HH+HV' WHEN 2 THEN 'HH' ELSE 'VV+HH' END AS pol FROM supplier")
def scl7(spark, sf):
    k = F.col("s_suppkey") % 4
    a = lambda *x: F.array(*map(F.lit, x))
    pols = F.when(k == 0, a("VH", "VV")).when(k == 1, a("HH", "HV")).when(k == 2, a("HH")).otherwise(a("VV", "HH"))
    return table(spark, sf, "supplier").select("s_suppkey", names.polarization_name(pols).alias("pol"))


@query("scl8_burst_key", "SELECT DISTINCT upper(replace(jpl_burst_id, '-', '_')) AS k FROM {A}")
def scl8(spark, sf):
    return acquisitions(spark, sf).select(names.burst_key(F.col("jpl_burst_id")).alias("k")).distinct()


TILE = "lpad(CAST(1 + p_partkey % 60 AS VARCHAR), 2, '0') || substr('CDEFGHJKLMNPQRSTUVWX', CAST(1 + p_size % 20 AS INTEGER), 1) || 'PU'"


@query("scl11_utm_epsg", f"SELECT p_partkey, CAST(CASE WHEN substr(tile, 3, 1) < 'N' THEN 32700 ELSE 32600 END + CAST(substr(tile, 1, 2) AS INTEGER) AS INTEGER) AS epsg FROM (SELECT p_partkey, {TILE} AS tile FROM part)")
def scl11(spark, sf):
    return _tiles(spark, sf).select("p_partkey", names.utm_epsg(F.col("tile")).alias("epsg"))


def _tiles(spark, sf):
    band = F.substr(F.lit("CDEFGHJKLMNPQRSTUVWX"), (1 + F.col("p_size") % 20).cast("int"), F.lit(1))
    return table(spark, sf, "part").select("p_partkey", "p_size", F.concat(F.lpad((1 + F.col("p_partkey") % 60).cast("string"), 2, "0"), band, F.lit("PU")).alias("tile"))


@query("scl12_band_names", "SELECT pol, bands FROM (VALUES ('VV+VH', 'VV,VH'), ('HH+HV', 'HH,HV')) t(pol, bands) WHERE pol IN (SELECT DISTINCT polarizations FROM {A})")
def scl12(spark, sf):
    pols = acquisitions(spark, sf).select(F.col("polarizations").alias("pol")).distinct().where(F.col("pol").contains("+"))
    return pols.select("pol", F.array_join(F.split("pol", r"\+"), ",").alias("bands"))


@query("scl13_subswath", "SELECT DISTINCT jpl_burst_id, regexp_extract(jpl_burst_id, '(IW[0-9])', 1) AS swath, CAST(string_split(jpl_burst_id, '-')[2] AS INTEGER) AS number FROM {A}")
def scl13(spark, sf):
    return acquisitions(spark, sf).select("jpl_burst_id", names.subswath(F.col("jpl_burst_id")).alias("s")).distinct().select("jpl_burst_id", "s.swath", "s.number")


@query("scl14_track_of_store", "SELECT item_id, nullif(regexp_extract(zarr_path, '_TK([0-9]+)', 1), '') AS track FROM {B}")
def scl14(spark, sf):
    return catalog(spark, sf).select("item_id", names.track_of_store(F.col("zarr_path")).alias("track"))


@query("scl15_store_token", f"SELECT p_partkey, regexp_extract(path, 'TK([0-9-]+)', 1) AS token, CAST(string_split(regexp_extract(path, 'TK([0-9-]+)', 1), '-')[1] AS INTEGER) AS track, CAST(regexp_extract(path, '_N([0-9]+)', 1) AS INTEGER) AS n_bursts FROM {STORES}")
def scl15(spark, sf):
    return _stores(spark, sf).select("p_partkey", names.store_token(F.col("path")).alias("s")).select("p_partkey", "s.*")


@query("scl16_17_parse_names", f"SELECT p_partkey, '17MPU' AS tile, regexp_extract(path, '([0-9]{{4}}-[0-9]{{2}})_', 1) AS month FROM {STORES}")
def scl16_17(spark, sf):
    p = F.col("path")
    return _stores(spark, sf).select("p_partkey", names.tile_in_path(p).alias("tile"), names.month_in_name(p).alias("month"))


@query("scl18_tile_bounds", f"SELECT p_size, min(tile) AS first_tile, max(tile) AS last_tile, count(*) AS n FROM (SELECT p_size, {TILE} AS tile FROM part) GROUP BY ALL")
def scl18(spark, sf):
    key = names.tile_sort_key(F.col("tile"))
    return _tiles(spark, sf).groupBy("p_size").agg(F.min_by("tile", key).alias("first_tile"), F.max_by("tile", key).alias("last_tile"), F.count("*").alias("n"))


@query("scl19_grid_id", """SELECT s_suppkey, substr(sha256('{"crs":"EPSG:32717","h":16,"res":30.0,"tile":"17MPU","transform":[30.0,0.0,' || (500000 + s_suppkey * 30) || '.0,0.0,-30.0,8500000.0],"v":8,"w":' || (24 + s_suppkey % 3) || '}'), 1, 12) AS grid_id FROM supplier""")
def scl19(spark, sf):
    t = F.array(*map(F.lit, (30.0, 0.0)), (500000 + F.col("s_suppkey") * 30).cast("double"), *map(F.lit, (0.0, -30.0, 8500000.0)))
    return table(spark, sf, "supplier").select("s_suppkey", names.grid_id(F.lit("17MPU"), F.lit("EPSG:32717"), t, 24 + F.col("s_suppkey") % 3, F.lit(16), F.lit(30.0), F.lit(8)).alias("grid_id"))


@query("scl20_grid_name", "SELECT s_suppkey, '17MPU_' || CASE WHEN s_suppkey % 2 = 0 THEN '30' ELSE '12.5' END || 'm_' || (s_suppkey % 7) AS name FROM supplier")
def scl20(spark, sf):
    res = F.when(F.col("s_suppkey") % 2 == 0, 30.0).otherwise(12.5)
    short = F.regexp_replace(F.format_string("%.6f", res), r"\.?0+$", "")
    return table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("17MPU_"), short, F.lit("m_"), (F.col("s_suppkey") % 7).cast("string")).alias("name"))


@query("scl21_rebase_paths", "SELECT item_id, CASE WHEN starts_with(zarr_path, 'NATION_1/') THEN zarr_path ELSE 'NATION_1/' || zarr_path END AS path FROM {B}")
def scl21(spark, sf):
    return catalog(spark, sf).select("item_id", names.rebase_path(F.col("zarr_path"), "NATION_1").alias("path"))


@query("scl22_normalize_record", "SELECT item_id, coalesce(flight_direction, 'UNKNOWN') AS flight_direction, coalesce(zarr_path, tile_id || '/items/' || item_id || '.json') AS item_path, 8 AS schema_version, '[\"VV\",\"VH\"]' AS bands FROM {B}")
def scl22(spark, sf):
    path = F.coalesce("zarr_path", F.format_string("%s/items/%d.json", "tile_id", "item_id"))
    return catalog(spark, sf).select("item_id", F.coalesce("flight_direction", F.lit("UNKNOWN")).alias("flight_direction"), path.alias("item_path"), F.lit(8).alias("schema_version"), F.to_json(F.array(F.lit("VV"), F.lit("VH"))).alias("bands"))


@query("scl23_processing_signature", """SELECT item_id, 'p' || substr(sha256('{"despeckle":"' || product_type || '","tile":"' || tile_id || '"}'), 1, 11) AS signature FROM {B}""")
def scl23(spark, sf):
    return catalog(spark, sf).select("item_id", names.processing_signature({"tile": F.col("tile_id"), "despeckle": F.col("product_type")}).alias("signature"))


@query("scl24_25_variant_token", "SELECT s_suppkey, concat_ws('_', 'smonthly', CASE WHEN s_suppkey % 2 = 0 THEN 'tv' END, CASE WHEN s_suppkey % 3 = 0 THEN 'glcm' END, '30m') AS variant FROM supplier")
def scl24_25(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", names.variant_name([(F.lit(True), F.lit("smonthly")), (k % 2 == 0, F.lit("tv")), (k % 3 == 0, F.lit("glcm")), (F.lit(True), F.lit("30m"))]).alias("variant"))


@query("scl26_layer_urls", "SELECT event_id, replace(url_copol, '_VV.tif', '_mask.tif') || ',' || replace(url_copol, '_VV.tif', '_rtc_anf.tif') AS urls FROM {A} WHERE url_copol IS NOT NULL")
def scl26(spark, sf):
    return acquisitions(spark, sf).where("url_copol IS NOT NULL").select("event_id", F.array_join(names.layer_urls(F.col("url_copol"), ("mask", "rtc_anf")), ",").alias("urls"))


KEYS_ADDED = "token=abc&b=2&ID_Token=q&X-Amz-Date=1&x-goog-y=2&sv=1&sig=z&secret=s&c%5Fd=4"


@query("scl27_sanitised_url", rf"""WITH u AS (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || CASE page_id % 2 WHEN 0 THEN '{KEYS_ADDED}' ELSE 'sv=1&plain=2' END || CASE page_id % 5 WHEN 0 THEN '#part' WHEN 1 THEN '#a&token=1' ELSE '' END AS u FROM (SELECT page_id, string_split(url, '#')[1] AS url FROM pages)),
    s AS (SELECT page_id, string_split(u, '#')[1] AS b, string_split(u, '#')[2] AS f FROM u),
    q AS (SELECT page_id, string_split(b, '?')[1] AS h, f, list_filter(string_split(b[length(string_split(b, '?')[1]) + 2:], '&'), lambda x: x <> '') AS q FROM s)
    SELECT page_id, CASE WHEN coalesce(f, '') <> 'a&token=1' THEN h || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END || coalesce('#' || f, '') END AS url
    FROM (SELECT page_id, h, f, list_filter(q, lambda x: NOT regexp_matches(lower(x), '^(token|id_token|access_token|signature|sig|secret|x-amz-[^=]*|x-goog-[^=]*)=') AND NOT (list_contains(q, 'sig=z') AND starts_with(x, 'sv='))) AS k FROM q)""")
def scl27(spark, sf):
    bare, odd = F.element_at(F.split("url", "#"), 1), F.col("page_id") % 2 != 0
    added = F.when(odd, "sv=1&plain=2").otherwise(KEYS_ADDED)
    anchor = F.when(F.col("page_id") % 5 == 0, "#part").when(F.col("page_id") % 5 == 1, "#a&token=1").otherwise("")
    return table(spark, sf, "pages").select("page_id", names.sanitised_url(F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), added, anchor)).alias("url"))


@query("scl28_canonical_json", """SELECT item_id, sha256('{"month":"' || month || '","tile":"' || tile_id || '"}') AS output_id FROM {B}""")
def scl28(spark, sf):
    return catalog(spark, sf).select("item_id", F.sha2(F.to_json(F.struct("month", F.col("tile_id").alias("tile"))), 256).alias("output_id"))


@query("scl29_local_paths", "SELECT event_id, 'data/' || burst || '/' || string_split(url_copol, '/')[4] AS path FROM {A} WHERE url_copol IS NOT NULL")
def scl29(spark, sf):
    return acquisitions(spark, sf).where("url_copol IS NOT NULL").select("event_id", names.local_path(F.col("url_copol"), F.lit("data"), F.col("burst").cast("string")).alias("path"))


@query("scl30_31_time_ranges", "SELECT y * 100 + m AS ym FROM (SELECT unnest(range(2019, 2026)) AS y) CROSS JOIN (SELECT unnest([1, 2, 6]) AS m) WHERE y * 100 + m < 202505")
def scl30_31(spark, sf):
    """Years times months, up to the last complete month before May 2025."""
    grid = spark.range(2019, 2026).select(F.col("id").alias("y"), F.explode(F.array(*map(F.lit, (1, 2, 6)))).alias("m"))
    return grid.select((F.col("y") * 100 + F.col("m")).alias("ym")).where("ym < 202505")


@query("scl32_chunk_by_year", "SELECT o_orderkey, y, greatest(CAST(o_orderdate AS DATE), make_date(y, 1, 1)) AS a, least(CAST(o_orderdate + INTERVAL 500 DAY AS DATE), make_date(y, 12, 31)) AS b FROM (SELECT *, unnest(range(year(o_orderdate), year(o_orderdate + INTERVAL 500 DAY) + 1)) AS y FROM orders)")
def scl32(spark, sf):
    start = F.to_date("o_orderdate")
    parts = table(spark, sf, "orders").select("o_orderkey", F.explode(names.split_by_year(start, F.date_add(start, 500))).alias("p"))
    return parts.select("o_orderkey", F.year("p.a").cast("long").alias("y"), "p.a", "p.b")


@query("scl33_chunk_by_strategy", "SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m') AS q, count(*) AS n FROM orders GROUP BY ALL")
def scl33(spark, sf):
    return table(spark, sf, "orders").groupBy(names.period_key(F.col("o_orderdate"), "quarterly").alias("q")).agg(F.count("*").alias("n"))


@query("scl34_memory_strategy", "SELECT p_partkey, round(p_size * 4 * d, 6) AS demand, CASE WHEN p_size * 48 * d <= 51.2 THEN 'yearly' WHEN p_size * 12 * d <= 51.2 THEN 'quarterly' ELSE 'monthly' END AS strategy FROM part, (SELECT 2 * (7180.0 * 6166 * 4 / 1073741824) * 0.25 * 1.5 AS d)")
def scl34(spark, sf):
    d = lambda months: names.demand_gb(F.col("p_size") * 4 * months, 7180, 6166)
    return table(spark, sf, "part").select("p_partkey", F.round(d(1), 6).alias("demand"), names.batch_strategy(d(12), d(3), d(1), 64.0).alias("strategy"))


@query("scl35_37_pixel_lattice", "SELECT c_custkey, CAST(floor((10000 - c_acctbal) / 30) AS BIGINT) AS row, CASE WHEN abs(c_nationkey * 29.9 / 30 - round(c_nationkey * 29.9 / 30)) <= 0.49 THEN CAST(round(c_nationkey * 29.9 / 30) AS BIGINT) END AS lattice FROM customer")
def scl35_37(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.floor((10000 - F.col("c_acctbal")) / 30).alias("row"), lattice_index(F.col("c_nationkey") * 29.9, 0.0, 30.0).alias("lattice"))


@query("scl36_utm_to_wgs84")
def scl36(spark, sf):
    c = F.col("c_custkey")
    p = names.utm_to_lonlat(300000.0 + c % 4000 * 100, 9000000.0 + c % 1000 * 500, F.lit(17), F.lit(True))
    return table(spark, sf, "customer").select("c_custkey", p.alias("p")).select("c_custkey", F.round("p.lon", 8).alias("lon"), F.round("p.lat", 8).alias("lat"))


@query("scl38_resampling_choice", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'nearest' WHEN s_suppkey % 2 = 0 THEN 'bilinear' ELSE 'nearest' END AS method FROM supplier")
def scl38(spark, sf):
    k = F.col("s_suppkey")
    res = F.when(k % 2 == 0, 10).otherwise(30)
    return table(spark, sf, "supplier").select("s_suppkey", F.when(k % 5 == 0, "nearest").when(res == 10, "bilinear").when(res == 30, "nearest").alias("method"))


@query("scl39_coerce_datetimes", "SELECT event_id, try_cast(CASE WHEN event_id % 4 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS t FROM events")
def scl39(spark, sf):
    raw = F.when(F.col("event_id") % 4 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", raw.try_cast("timestamp_ntz").alias("t"))


@query("scl40_json_safe", "SELECT block_id, row, col, '{' || CASE WHEN v IS NULL THEN '' ELSE '\"s\":' || (v > 0) END || '}' AS j FROM {D}")
def scl40(spark, sf):
    return chunks(spark, sf).select("block_id", "row", "col", F.to_json(F.struct((F.col("v") > 0).alias("s"))).alias("j"))


@query("scl41_plan_size", "SELECT p_size, round((109800.0 / 30) * (109800.0 / 30) * 4 * 4 * p_size * 3 * 2 / 1073741824, 6) AS gib FROM (SELECT DISTINCT p_size FROM part)")
def scl41(spark, sf):
    return table(spark, sf, "part").select("p_size").distinct().select("p_size", F.round(names.plan_gib(F.lit(4), F.col("p_size"), F.lit(3), F.lit(2)), 6).alias("gib"))


@query("scl42_lookback_expansion", "SELECT i, 365 * i AS delta_days, 10 AS max_pre FROM (SELECT CAST(unnest(range(1, 4)) AS BIGINT) AS i)")
def scl42(spark, sf):
    return spark.range(1, 4).select(F.col("id").alias("i"), (365 * F.col("id")).alias("delta_days"), F.lit(10).alias("max_pre"))


@query("scl43_angle_contrast", "SELECT l_orderkey, l_linenumber, abs(l_quantity - l_tax * 100) AS contrast, l_quantity BETWEEN 5 AND 45 AND l_tax < 0.06 AS valid FROM lineitem")
def scl43(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.abs(q - F.col("l_tax") * 100).alias("contrast"), (q.between(5, 45) & (F.col("l_tax") < 0.06)).alias("valid"))


@query("scl44_item_paths", "SELECT item_id, tile_id || '/stac/' || item_id || '_' || month || '.json' AS path FROM {B}")
def scl44(spark, sf):
    return catalog(spark, sf).select("item_id", F.format_string("%s/stac/%d_%s.json", "tile_id", "item_id", "month").alias("path"))


@query("scl45_quality_rules", "SELECT block_id, band, CASE WHEN count(v) = 0 THEN 'empty' WHEN band % 2 = 0 AND min(v) < -0.19 THEN 'range' ELSE 'ok' END AS verdict FROM {D} GROUP BY block_id, band")
def scl45(spark, sf):
    g = chunks(spark, sf).groupBy("block_id", "band").agg(F.count("v").alias("n"), F.min("v").alias("lo"))
    return g.select("block_id", "band", F.when(F.col("n") == 0, "empty").when((F.col("band") % 2 == 0) & (F.col("lo") < F.lit(-0.19)), "range").otherwise("ok").alias("verdict"))


@query("scl46_band_range_checks", "SELECT block_id, min(v) < -0.19 OR max(v) > 0.4 AS out_of_range, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) > 0.05 AS too_sparse FROM {D} GROUP BY ALL")
def scl46(spark, sf):
    bad = (F.min("v") < F.lit(-0.19)) | (F.max("v") > F.lit(0.4))
    return chunks(spark, sf).groupBy("block_id").agg(bad.alias("out_of_range"), (F.avg(F.col("v").isNull().cast("double")) > 0.05).alias("too_sparse"))
