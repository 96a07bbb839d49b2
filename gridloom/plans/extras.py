"""Queries of scans, exports and helpers that the other modules leave."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import names
from gridloom.operators import raster
from gridloom.plans.bind import acquisitions, catalog, cells, chunks, query, table
from gridloom.sources import sinks, tables
from gridloom.streaming.cube import scratch


@query("src6_partitioned_scan", "SELECT opera_id, burst FROM {A} WHERE burst IN (1, 4, 7, 12, 20)")
def src6(spark, sf):
    """A union of scans by chunks of ids is the scan by all ids; as one IN list Spark splits it by files."""
    chunks_of_ids = [(1, 4), (7, 12), (20,)]
    return acquisitions(spark, sf).where(F.col("burst").isin([i for ids in chunks_of_ids for i in ids])).select("opera_id", "burst")


@query("src7_static_layers_latest", "SELECT burst, max(opera_id) AS opera_id FROM {A} WHERE url_copol IS NOT NULL AND burst < 12 GROUP BY ALL")
def src7(spark, sf):
    """The latest product of each burst among those with a layer link."""
    a = acquisitions(spark, sf).where("url_copol IS NOT NULL AND burst < 12")
    return a.groupBy("burst").agg(F.max("opera_id").alias("opera_id"))


@query("src10_14_decoded_rasters", "SELECT block_id, count(v) AS n_valid, count(*) AS n, CAST(NULL AS VARCHAR) AS error FROM {D} WHERE block_id % 10 <> 3 GROUP BY ALL UNION ALL SELECT vec_id, 0, 0, 'truncated' FROM embeddings WHERE vec_id % 20 = 3 UNION ALL SELECT vec_id, 0, 0, 'not_a_raster' FROM embeddings WHERE vec_id % 20 = 13")
def src10_14(spark, sf):
    """Raster files of raw floats decoded in batches, with an error class for a file that is none; values at or under the
    nodata threshold are NULL. The files are made here from the embeddings, some cut short and some with another mark."""
    files = tables.as_rasters(table(spark, sf, "embeddings"), "vec_id", "embedding", 8)
    body = F.when(F.col("vec_id") % 20 == 3, F.col("content").substr(F.lit(1), F.length("content") - 5)).when(F.col("vec_id") % 20 == 13, F.concat(F.lit(b"XX"), "content")).otherwise(F.col("content"))
    r = tables.decode_rasters(files.select("vec_id", body.alias("content")), "vec_id", "content")
    n_valid = F.when(F.col("error").isNull(), F.size(F.filter("values", lambda v: v > F.lit(-0.2).cast("float")))).otherwise(0)
    return r.select(F.col("vec_id").alias("block_id"), n_valid.cast("long").alias("n_valid"), F.when(F.col("error").isNull(), F.col("height") * F.col("width")).otherwise(0).cast("long").alias("n"), "error")


@query("src15_16_cube_scan", "SELECT scene_id, seq, vv FROM {C} WHERE month = '1998-03' AND track = 2")
def src15_16(spark, sf):
    return cells(spark, sf).where("month = '1998-03' AND track = 2").select("scene_id", "seq", "vv")


@query("src23_window_read", "SELECT row, col, count(*) AS n, round(sum(vv), 4) AS total FROM {C} WHERE row BETWEEN 2 AND 4 AND col BETWEEN 1 AND 3 GROUP BY ALL")
def src23(spark, sf):
    """A cube written in blocks and read by a window: blocks beside it are pruned as partitions. Each task of the scan writes
    its own part of every block, so the few blocks' size bounds no task."""
    path = f"{scratch(spark)}/window"
    c = cells(spark, sf).select("row", "col", "vv", F.floor(F.col("row") / 4).alias("block_y"), F.floor(F.col("col") / 4).alias("block_x"))
    c.write.partitionBy("block_y", "block_x").parquet(path)
    return tables.read_window(spark, path, (2, 5), (1, 4), 4).groupBy("row", "col").agg(F.count("*").alias("n"), F.round(F.sum("vv"), 4).alias("total"))


@query("src28_xml_metadata", "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier")
def src28(spark, sf):
    doc = F.concat(F.lit("<p><id>"), F.col("s_suppkey").cast("string"), F.lit("</id><m><name>"), F.col("s_name"), F.lit("</name></m></p>"))
    x = table(spark, sf, "supplier").select("s_suppkey", doc.alias("value"))
    field = lambda p: F.xpath_string(F.col("value"), F.lit(p))
    return x.select("s_suppkey", field("p/id").alias("id"), field("p/m/name").alias("name"))


@query("src29_30_geojson_boxes", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_nationkey * 1.0 AS xmin, -5.0 AS ymin, s_nationkey + 2.0 AS xmax, 3.0 AS ymax FROM supplier")
def src29(spark, sf):
    ring = F.format_string("[[%d,-5],[%d,-5],[%d,3],[%d,-5]]", "s_nationkey", F.col("s_nationkey") + 2, "s_nationkey", "s_nationkey")
    doc = F.concat(F.lit('{"features":[{"id":"'), F.col("s_suppkey").cast("string"), F.lit('","geometry":{"type":"Polygon","coordinates":['), ring, F.lit("]}}]}"))
    return tables.geojson_boxes(table(spark, sf, "supplier").select(doc.alias("value")))


@query("snk1_3_store_round_trip", "SELECT month, count(*) AS n, round(sum(vv), 4) AS total FROM {C} GROUP BY ALL")
def snk1_3(spark, sf):
    """A store made with its grid locked, read back by month."""
    path = f"{scratch(spark)}/store"
    c = cells(spark, sf).select("t", "month", F.floor(F.col("row") / 4).alias("block_y"), F.floor(F.col("col") / 4).alias("block_x"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "track", "scene_id", "vv", "vh")
    sinks.create_store(c, path, {"height": 8, "width": 6})
    return spark.read.parquet(path).groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("vv"), 4).alias("total"))


@query("snk10_catalog_file", "SELECT item_id, month FROM {B}")
def snk10(spark, sf):
    path = f"{scratch(spark)}/catalog"
    sinks.write_catalog(catalog(spark, sf).select("item_id", "tile_id", "product_type", "datetime", "month"), path)
    return spark.read.parquet(path).select("item_id", "month")


@query("snk11_chunk_export", "SELECT block_id, count(*) AS h_w, count(v) AS n_valid FROM {D} GROUP BY ALL")
def snk11(spark, sf):
    """The raster export: blocks of values in row order with their extent."""
    c = sinks.chunk_table(chunks(spark, sf), ["block_id"], "v")
    return c.select("block_id", (F.col("h") * F.col("w")).cast("long").alias("h_w"), F.size(F.filter("values", lambda v: v.isNotNull())).cast("long").alias("n_valid"))


@query("snk12_missing_previews", "SELECT DISTINCT tile_id, month FROM {B} e WHERE e.status = 'complete' AND NOT EXISTS (SELECT 1 FROM {B} a WHERE a.item_id % 5 = 0 AND a.tile_id = e.tile_id AND a.month = e.month)")
def snk12(spark, sf):
    b = catalog(spark, sf)
    return sinks.missing_previews(b.where("status = 'complete'").select("tile_id", "month").distinct(), b.where("item_id % 5 = 0"), ["tile_id", "month"])


@query("snk15_16_items_nested", "SELECT item_id, tile_id AS tile, zarr_path AS href FROM {B}")
def snk15_16(spark, sf):
    """Items with nested assets, written and read back as nested columns."""
    path = f"{scratch(spark)}/items"
    items = catalog(spark, sf).select("item_id", F.struct(F.col("tile_id").alias("tile")).alias("properties"), F.create_map(F.lit("zarr"), F.struct(F.col("zarr_path").alias("href"))).alias("assets"))
    items.write.parquet(path)
    return spark.read.parquet(path).select("item_id", F.col("properties.tile").alias("tile"), F.col("assets")["zarr"]["href"].alias("href"))


@query("snk18_provenance_tables", "SELECT output_id, count(*) AS n FROM (SELECT DISTINCT 'o' || l_orderkey AS output_id, 's' || l_suppkey AS source_id FROM lineitem) GROUP BY ALL")
def snk18(spark, sf):
    path = f"{scratch(spark)}/links"
    li = table(spark, sf, "lineitem")
    named = [F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("output_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id")]
    links = li.select("l_orderkey", "l_suppkey").distinct().select(*named, F.lit("g1").alias("generation"), F.lit("vv").alias("variable"), F.lit("input").alias("role"))
    sinks.write_provenance(links, li.select(named[0]), li.select(named[1]), path, tables.SOURCE_LINKS)
    return tables.read_strict(spark, path, tables.SOURCE_LINKS).groupBy("output_id").agg(F.count("*").alias("n"))


@query("snk20_static_store", "SELECT p_partkey % 8 AS row, p_size % 6 AS col, min(p_retailprice) AS dem, count(*) AS n FROM part GROUP BY ALL")
def snk20(spark, sf):
    path = f"{scratch(spark)}/static"
    p = table(spark, sf, "part").groupBy((F.col("p_partkey") % 8).alias("row"), (F.col("p_size") % 6).alias("col")).agg(F.min("p_retailprice").alias("dem"), F.count("*").alias("n"))
    p.write.parquet(path)
    return spark.read.parquet(path)


@query("snk22_run_summary", "SELECT tile_id, '{\"ok\":' || count(*) FILTER (status = 'complete') || ',\"failed\":' || count(*) FILTER (status <> 'complete') || '}' AS summary FROM {B} GROUP BY tile_id")
def snk22(spark, sf):
    g = catalog(spark, sf).groupBy("tile_id").agg(F.count_if(F.col("status") == "complete").alias("ok"), F.count_if(F.col("status") != "complete").alias("failed"))
    path = f"{scratch(spark)}/summary"
    g.select("tile_id", F.to_json(F.struct("ok", "failed")).alias("summary")).write.json(path)
    return spark.read.schema("tile_id string, summary string").json(path)


@query("snk24_grid_rows", "SELECT DISTINCT grid_id, 'EPSG:' || (32700 + CAST(substr(grid_id, 2) AS INTEGER)) AS crs FROM {B} WHERE grid_id IS NOT NULL")
def snk24(spark, sf):
    g = catalog(spark, sf).where("grid_id IS NOT NULL").select("grid_id").distinct()
    return g.select("grid_id", F.concat(F.lit("EPSG:"), (32700 + F.substring("grid_id", 2, 9).cast("int")).cast("string")).alias("crs"))


@query("flt24_patch_min_valid", "SELECT block_id, y0, x0 FROM {D}, (SELECT unnest([0, 4]) AS y0), (SELECT unnest([0, 4]) AS x0) WHERE row >= y0 AND row < y0 + 4 AND col >= x0 AND col < x0 + 4 GROUP BY ALL HAVING count(v) >= 0.95 * 16")
def flt24(spark, sf):
    return raster.patches(chunks(spark, sf), ["block_id"], 8, 8, 4, 4).where("valid >= 0.95").select("block_id", "y0", "x0")


@query("agg39_hole_ratio", "SELECT block_id, round((count(*) - count(v)) * 1.0 / count(*), 6) AS missing_share FROM {D} GROUP BY ALL")
def agg39(spark, sf):
    return chunks(spark, sf).groupBy("block_id").agg(F.round((F.count("*") - F.count("v")) / F.count("*"), 6).alias("missing_share"))


@query("win16_cumulative_fraction", "SELECT month, track, round(sum(n) OVER (PARTITION BY track ORDER BY month ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY track), 8) AS cum FROM (SELECT month, track, count(*) AS n FROM {C} GROUP BY ALL)")
def win16(spark, sf):
    n = cells(spark, sf).groupBy("month", "track").agg(F.count("*").alias("n"))
    w = Window.partitionBy("track")
    run = F.sum("n").over(w.orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return n.select("month", "track", F.round(run / F.sum("n").over(w), 8).alias("cum"))


@query("win18_lru_victims", "SELECT source, count(*) AS n FROM (SELECT source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running > 50000 GROUP BY ALL")
def win18(spark, sf):
    w = Window.partitionBy("source").orderBy(F.col("doc_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "documents").select("source", F.sum("n_chars").over(w).alias("running")).where("running > 50000").groupBy("source").agg(F.count("*").alias("n"))


@query("arr2_ordered_block_map", "SELECT CAST(floor(row / 4) AS BIGINT) AS by, CAST(floor(col / 4) AS BIGINT) AS bx, max(v) AS hi, count(v) AS n FROM {D} GROUP BY ALL")
def arr2(spark, sf):
    """The parallel map over blocks: blocks are keys, tasks the workers."""
    return chunks(spark, sf).groupBy(F.floor(F.col("row") / 4).alias("by"), F.floor(F.col("col") / 4).alias("bx")).agg(F.max("v").alias("hi"), F.count("v").alias("n"))


@query("arr9_block_bands", "SELECT month, row, col, round(10 * log10(max(vv)), 6) AS vv_db, count(*) AS n_obs FROM {C} WHERE vv > 0 GROUP BY ALL")
def arr9(spark, sf):
    from gridloom.functions.radar import to_db

    return cells(spark, sf).where("vv > 0").groupBy("month", "row", "col").agg(F.round(to_db(F.max("vv")), 6).alias("vv_db"), F.count("*").alias("n_obs"))


@query("arr18_texture_band_names", "SELECT unnest(['VV_glcm_CONTR', 'VV_glcm_IDM', 'VV_glcm_ENT', 'VV_glcm_CORR', 'VH_glcm_CONTR', 'VH_glcm_IDM', 'VH_glcm_ENT', 'VH_glcm_CORR']) AS band")
def arr18(spark, sf):
    metrics = F.array(*map(F.lit, ("CONTR", "IDM", "ENT", "CORR")))
    bands = spark.range(1).select(F.explode(F.array(F.lit("VV"), F.lit("VH"))).alias("b"))
    return bands.select("b", F.explode(metrics).alias("m")).select(F.concat("b", F.lit("_glcm_"), "m").alias("band"))


@query("arr28_static_over_time", "WITH s AS (SELECT p_partkey % 8 AS row, min(p_retailprice) AS dem FROM part GROUP BY ALL) SELECT c.month, c.row, any_value(s.dem) AS dem, count(*) AS n FROM {C} c JOIN s USING (row) GROUP BY ALL")
def arr28(spark, sf):
    """Static values join once per grouped row; they are not repeated for each observation."""
    s = table(spark, sf, "part").groupBy((F.col("p_partkey") % 8).alias("row")).agg(F.min("p_retailprice").alias("dem"))
    return cells(spark, sf).groupBy("month", "row").agg(F.count("*").alias("n")).join(s, "row").select("month", "row", "dem", "n")


@query("arr30_legacy_merge", "SELECT month, row, col, round(min(vh) / (min(vv) + 1e-10), 6) AS ratio FROM {C} WHERE vv > 0.001 AND vh > 0.001 GROUP BY ALL")
def arr30(spark, sf):
    from gridloom.functions.radar import legacy_ratio

    m = cells(spark, sf).where("vv > 0.001 AND vh > 0.001").groupBy("month", "row", "col").agg(F.min("vv").alias("vv"), F.min("vh").alias("vh"))
    return m.select("month", "row", "col", F.round(legacy_ratio(F.col("vv"), F.col("vh")), 6).alias("ratio"))


@query("msc6_mosaic_selection", "SELECT item_id, zarr_path FROM {B} WHERE month = '1999-09' AND flight_direction IS NOT NULL AND zarr_path IS NOT NULL")
def msc6(spark, sf):
    return catalog(spark, sf).where("month = '1999-09' AND flight_direction IS NOT NULL AND zarr_path IS NOT NULL").select("item_id", "zarr_path")


@query("msc8_localised_rows", "SELECT event_id, 'local/' || track_number || '/' || string_split(url_copol, '/')[4] AS path FROM {A} WHERE url_copol IS NOT NULL AND url_crosspol <> ''")
def msc8(spark, sf):
    a = acquisitions(spark, sf).where("url_copol IS NOT NULL AND url_crosspol <> ''")
    return a.select("event_id", names.local_path(F.col("url_copol"), F.lit("local"), F.col("track_number").cast("string")).alias("path"))


@query("msc4_reference_tracks", "SELECT DISTINCT CAST(regexp_extract(zarr_path, '_TK([0-9]+)', 1) AS INTEGER) AS track FROM {B} WHERE zarr_path IS NOT NULL AND tile_id = 'NATION_8'")
def msc4(spark, sf):
    b = catalog(spark, sf).where("zarr_path IS NOT NULL AND tile_id = 'NATION_8'")
    return b.select(names.track_of_store(F.col("zarr_path")).cast("int").alias("track")).distinct()
