"""Views that bind the engine's tables (acquisitions, catalog, cells, chunks, ...) to the test tables, in DataFrame and SQL form."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import share_code

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where there is one; {A}, {L}, {B}, {C}, {D} name the views."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            text = sql
            for mark, view in VIEWS.items():
                text = text.replace("{" + mark + "}", f"({view})")
            ORACLE[name] = text
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


VIEWS = {
    "A": """SELECT 'OP_' || event_id AS opera_id, event_id, 'T' || lpad(CAST(user_id % 7 AS VARCHAR), 3, '0') || '-' || lpad(CAST(user_id % 24 AS VARCHAR), 6, '0') || '-IW' || CAST(1 + user_id % 3 AS VARCHAR) AS jpl_burst_id,
        user_id % 24 AS burst, ts AS acq_dt, user_id % 7 AS track_number, CASE WHEN event_type IN ('click', 'view') THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit_pass,
        CASE event_type WHEN 'click' THEN 'VV+VH' WHEN 'view' THEN 'HH+HV' WHEN 'error' THEN 'VV' WHEN 'signup' THEN 'VV+VH' ELSE 'HH' END AS polarizations,
        CASE WHEN user_id % 11 = 0 THEN NULL ELSE 'https://data.example.org/' || event_id || '_VV.tif' END AS url_copol, CASE WHEN user_id % 13 = 0 THEN '' ELSE 'https://data.example.org/' || event_id || '_VH.tif' END AS url_crosspol, value FROM events""",
    "L": """SELECT b.burst, n.n_name AS mgrs_tile_id, n.n_regionkey AS acq_group_id, CAST(100 + (b.burst * 7 + n.n_nationkey) % 50 AS BIGINT) AS area_km2
        FROM nation n JOIN (SELECT DISTINCT user_id % 24 AS burst FROM events) b ON b.burst % 25 = n.n_nationkey OR b.burst % 25 = n.n_nationkey - 1""",
    "B": """SELECT o_orderkey AS item_id, n_name AS tile_id, CASE o_orderstatus WHEN 'F' THEN 'ASCENDING' WHEN 'O' THEN 'DESCENDING' END AS flight_direction, o_orderpriority AS product_type, o_orderdate AS datetime,
        strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderkey % 10 = 0 THEN 'partial' ELSE 'complete' END AS status, 8 - CAST(o_orderkey % 7 = 0 AS INTEGER) AS schema_version,
        CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'g' || (o_custkey % 5) END AS grid_id, 'p' || (o_orderkey % 3) AS processing_signature, o_custkey % 4 AS geometry_group_id, o_custkey % 6 AS track,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE n_name || '/s1_' || n_name || '_TK' || (o_custkey % 6) || '.zarr' END AS zarr_path, o_totalprice AS size
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "C": """SELECT l_partkey % 8 AS row, l_suppkey % 6 AS col, l_shipdate AS t, strftime(l_shipdate, '%Y-%m') AS month, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS track, l_orderkey AS scene_id, l_linenumber AS seq,
        l_quantity / 50 AS vv, CASE WHEN l_discount > 0 THEN l_discount END AS vh FROM lineitem""",
    "D": """SELECT vec_id AS block_id, label AS band, CAST(floor(p / 8) AS BIGINT) AS row, p % 8 AS col, CASE WHEN v > -0.2 THEN v END AS v
        FROM (SELECT vec_id, label, unnest(range(0, len(embedding))) AS p, unnest(embedding) AS v FROM embeddings)""",
}


def acquisitions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    u = F.col("user_id")
    pol = F.create_map(*[F.lit(x) for kv in {"click": "VV+VH", "view": "HH+HV", "error": "VV", "signup": "VV+VH", "purchase": "HH"}.items() for x in kv])
    burst = F.concat(F.lit("T"), F.lpad((u % 7).cast("string"), 3, "0"), F.lit("-"), F.lpad((u % 24).cast("string"), 6, "0"), F.lit("-IW"), (1 + u % 3).cast("string"))
    url = lambda end: F.concat(F.lit("https://data.example.org/"), F.col("event_id").cast("string"), F.lit(end))
    return e.select(
        F.concat(F.lit("OP_"), F.col("event_id").cast("string")).alias("opera_id"), "event_id", burst.alias("jpl_burst_id"), (u % 24).alias("burst"), F.col("ts").alias("acq_dt"), (u % 7).alias("track_number"),
        F.when(F.col("event_type").isin("click", "view"), "ASCENDING").otherwise("DESCENDING").alias("orbit_pass"), pol[F.col("event_type")].alias("polarizations"),
        F.when(u % 11 != 0, url("_VV.tif")).alias("url_copol"), F.when(u % 13 == 0, "").otherwise(url("_VH.tif")).alias("url_crosspol"), "value",
    )


def burst_lut(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts and tiles, many to many: a burst lies in two tiles. The burst number gives both tiles, so the join has keys."""
    bursts = table(spark, sf, "events").select((F.col("user_id") % 24).alias("burst")).distinct()
    both = bursts.select("burst", F.explode(F.array(F.col("burst") % 25, F.col("burst") % 25 + 1)).alias("n_nationkey"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "n_regionkey")
    return both.join(n, "n_nationkey").select("burst", F.col("n_name").alias("mgrs_tile_id"), F.col("n_regionkey").alias("acq_group_id"), (100 + (F.col("burst") * 7 + F.col("n_nationkey")) % 50).alias("area_km2"))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == c.c_custkey).join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    path = F.concat("n_name", F.lit("/s1_"), "n_name", F.lit("_TK"), (cust % 6).cast("string"), F.lit(".zarr"))
    return j.select(
        key.alias("item_id"), F.col("n_name").alias("tile_id"), F.when(F.col("o_orderstatus") == "F", "ASCENDING").when(F.col("o_orderstatus") == "O", "DESCENDING").alias("flight_direction"), F.col("o_orderpriority").alias("product_type"),
        F.col("o_orderdate").alias("datetime"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.when(key % 10 == 0, "partial").otherwise("complete").alias("status"), (8 - (key % 7 == 0).cast("int")).alias("schema_version"),
        F.when(key % 9 != 0, F.concat(F.lit("g"), (cust % 5).cast("string"))).alias("grid_id"), F.concat(F.lit("p"), (key % 3).cast("string")).alias("processing_signature"), (cust % 4).alias("geometry_group_id"), (cust % 6).alias("track"),
        F.when(key % 17 != 0, path).alias("zarr_path"), F.col("o_totalprice").alias("size"),
    )


def placed(df: DataFrame) -> DataFrame:
    """A table with each row's place: files in order of their names, rows in order of their file. Where an order leaves a tie
    open, place decides it: first come, first served, as in the SQL's engine."""
    # the two ways to name a file write its scheme with one slash or with three
    files, path = sorted({re.sub("^([a-z0-9]+):/+", r"\1:/", f) for f in df.inputFiles()}), F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):/+", "$1:/")
    if len(files) < 2:
        return df.select("*", F.col("_metadata.row_index").alias("place"))
    numbers = df.sparkSession.createDataFrame(list(enumerate(files)), "_file long, _path string")
    found = df.select("*", F.col("_metadata.row_index").alias("_row"), path.alias("_path")).join(F.broadcast(numbers), "_path", "left")
    number = F.coalesce("_file", F.raise_error(F.concat(F.lit("not a file of the table: "), "_path")).cast("long"))
    return found.withColumn("place", number * 10**12 + F.col("_row")).drop("_path", "_file", "_row")


def placed_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf, placed(table(spark, sf, "lineitem")), "place")


def cells(spark: SparkSession, sf: str, li: DataFrame | None = None, *more: str) -> DataFrame:
    li = table(spark, sf, "lineitem") if li is None else li
    return li.select(
        (F.col("l_partkey") % 8).alias("row"), (F.col("l_suppkey") % 6).alias("col"), F.col("l_shipdate").alias("t"), F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("track"), F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("seq"),
        (F.col("l_quantity") / 50).alias("vv"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("vh"), *more,
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 blocks from vectors; values at or under -0.2 are nodata."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("block_id"), F.col("label").alias("band"), F.posexplode("embedding").alias("p", "v"))
    return e.select("block_id", "band", F.floor(F.col("p") / 8).alias("row"), (F.col("p") % 8).cast("long").alias("col"), F.when(F.col("v") > -0.2, F.col("v")).alias("v"))
