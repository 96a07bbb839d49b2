"""Sinks: cube stores with a locked grid, catalogs, STAC documents, provenance tables, exports.

Writers assume one writer a store, as jobs of a scheduler are. A folder appears with Spark's commit, so readers never
see half a write.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.relational import upsert
from gridloom.sources.tables import schema

PARTITIONS = ("month", "block_y", "block_x")


def check_grid(cells: DataFrame, grid: dict[str, int]) -> DataFrame:
    """cells, with an error where a place lies outside the store's grid."""
    outside = ~(F.col("row").between(0, grid["height"] - 1) & F.col("col").between(0, grid["width"] - 1))
    return cells.withColumn("row", F.when(outside, F.raise_error(F.lit("a cell outside the store's grid")).cast("int")).otherwise(F.col("row")))


def check_bands(cells: DataFrame, store: DataFrame) -> None:
    """A store's bands are fixed when it is made."""
    if set(cells.columns) != set(store.columns):
        raise ValueError(f"bands differ from the store's: {sorted(set(cells.columns) ^ set(store.columns))}")


def create_store(cells: DataFrame, path: str, grid: dict[str, int], partitions: Sequence[str] = PARTITIONS) -> None:
    """A new cube; a store that is there is an error. Cells of a block lie together, in order of time."""
    dealt = check_grid(cells, grid).repartition(*partitions).sortWithinPartitions(*partitions, "t", "row", "col")
    dealt.write.partitionBy(*partitions).mode("errorifexists").parquet(path)


def append_steps(cells: DataFrame, path: str, grid: dict[str, int], partitions: Sequence[str] = PARTITIONS) -> None:
    """Append time steps; one that the store has already is an error, and nothing is written."""
    store = cells.sparkSession.read.parquet(path)
    check_bands(cells, store)
    if not cells.select("t").join(store.select("t"), "t", "left_semi").isEmpty():
        raise ValueError("the store has this time step")
    dealt = check_grid(cells, grid).repartition(*partitions).sortWithinPartitions(*partitions, "t", "row", "col")
    dealt.write.partitionBy(*partitions).mode("append").parquet(path)


def replace_months(cells: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS) -> None:
    """Overwrite the partitions that cells touch and no others."""
    cells.repartition(*partitions).write.partitionBy(*partitions).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def delete_month(spark: SparkSession, path: str, month: str) -> None:
    """Remove a month's partition."""
    remove(spark, f"{path}/month={month}")


def move_new(spark: SparkSession, source: str, path: str) -> None:
    """Give a written folder its name; a folder that is there is an error."""
    old, new = spark._jvm.org.apache.hadoop.fs.Path(source), spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = new.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(new) or not fs.rename(old, new):
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def typed_bands(bands: dict[str, str]) -> list[Column]:
    """Store types: counts as SMALLINT with 0 for missing, the rest as FLOAT with NULL."""
    return [F.coalesce(F.col(b), F.lit(0)).cast("smallint").alias(b) if kind == "count" else F.col(b).cast("float").alias(b) for b, kind in bands.items()]


def chunk_table(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Cells as blocks of values in row order; cells that are not there are NULL inside a block's extent."""
    packed = F.array_sort(F.collect_list(F.struct("row", "col", F.col(value).alias("v"))))
    c = cells.groupBy(*keys).agg(packed.alias("p"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    found = F.map_from_entries(F.transform("p", lambda s: F.struct((s["row"] - F.col("r0")) * (F.col("c1") - F.col("c0") + 1) + s["col"] - F.col("c0"), s["v"])))
    h, w = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    return c.withColumn("m", found).select(*keys, "r0", "c0", h.alias("h"), w.alias("w"), F.transform(F.sequence(F.lit(0).cast("long"), (h * w - 1).cast("long")), lambda i: F.try_element_at(F.col("m"), i)).alias("values"))


def cells_of(chunks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The inverse: one row a cell."""
    e = chunks.select(*keys, "r0", "c0", "w", F.posexplode("values").alias("pos", value))
    return e.select(*keys, (F.col("r0") + F.floor(F.col("pos") / F.col("w"))).alias("row"), (F.col("c0") + F.col("pos") % F.col("w")).alias("col"), value)


def merge_catalogs(tables: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Catalogs with differing columns as one; of a key the row of the last table stays, then the last in order."""
    out = tables[0]
    for t in tables[1:]:
        out = upsert(out, t, keys, order)
    return upsert(out, out.limit(0), keys, order)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """One file, in order, replaced as a whole."""
    catalog.orderBy("tile_id", "product_type", F.col("datetime").asc_nulls_last()).coalesce(1).write.mode("overwrite").parquet(path)


def stac_item(row: dict[str, Column], assets: dict[str, Column]) -> Column:
    """A STAC item as JSON; assets without a link are left out."""
    links = F.map_filter(F.create_map(*[x for k, v in assets.items() for x in (F.lit(k), F.struct(v.alias("href")))]), lambda _, s: s["href"].isNotNull())
    bbox = F.array(*[row["bbox"][k] for k in ("xmin", "ymin", "xmax", "ymax")])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), row["id"].alias("id"), row["collection"].alias("collection"), bbox.alias("bbox"), F.struct(*[v.alias(k) for k, v in row.items() if k not in ("id", "collection", "bbox")]).alias("properties"), links.alias("assets")))


def stac_collection(items: DataFrame, id_: str) -> DataFrame:
    """One row: extent and summaries of all items, as JSON."""
    box = F.array(F.min("bbox.xmin"), F.min("bbox.ymin"), F.max("bbox.xmax"), F.max("bbox.ymax"))
    extent = F.struct(F.struct(F.array(box).alias("bbox")).alias("spatial"), F.struct(F.array(F.array(F.min("datetime"), F.max("datetime"))).alias("interval")).alias("temporal"))
    summaries = F.struct(F.array_sort(F.collect_set("tile")).alias("tiles"), F.array_sort(F.collect_set("orbit_state")).alias("orbit_states"))
    return items.agg(F.to_json(F.struct(F.lit("Collection").alias("type"), F.lit(id_).alias("id"), extent.alias("extent"), summaries.alias("summaries"))).alias("collection"))


def write_provenance(links: DataFrame, outputs: DataFrame, sources: DataFrame, path: str, ddl: str) -> None:
    """Source links in their fixed schema, after the checks: no link twice, none without its output or source."""
    spark, staged = links.sparkSession, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    links.select(*[F.col(f.name).cast(f.dataType) for f in schema(ddl)]).write.parquet(staged)
    try:
        links = spark.read.schema(schema(ddl)).parquet(staged)  # the checks need the links several times, but not their making
        for key, there in (("output_id", outputs), ("source_id", sources)):
            # ids first become few, and are then joined
            if links.select(key).distinct().join(there.select(key).distinct(), key, "left_anti").count():
                raise ValueError(f"links without an output or source: {key}")
        if links.groupBy("output_id", "source_id", "variable").count().where("count > 1").count():
            raise ValueError("links given twice")
        move_new(spark, staged, path)
    finally:
        remove(spark, staged)


def band_stats(cells: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Count, mean, population deviation, minimum and maximum of each band, one row a band."""
    s = cells.agg(*[F.struct(F.count(b).alias("n"), F.avg(b).alias("mean"), F.stddev_pop(b).alias("std"), F.min(b).alias("min"), F.max(b).alias("max")).alias(b) for b in bands])
    return s.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("s")) for b in bands])).alias("x")).select("x.band", "x.s.*")


def missing_previews(expected: DataFrame, assets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Derived assets that are not there yet."""
    return expected.join(assets.select(*keys), list(keys), "left_anti")
