"""Schemas of the engine's tables and strict readers for them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BBOX = "STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>"
ACQUISITIONS = f"opera_id STRING, jpl_burst_id STRING, acq_dt TIMESTAMP, polarizations STRING, track_number INT, pass_id INT, url_copol STRING, url_crosspol STRING, bbox {BBOX}"
TILED_ACQUISITIONS = ACQUISITIONS + ", mgrs_tile_id STRING, acq_group_id_within_mgrs_tile INT, track_token STRING, orbit_pass STRING, acq_date_for_mgrs_pass STRING"
BURST_LUT = "jpl_burst_id STRING, mgrs_tile_id STRING, track_number INT, acq_group_id_within_mgrs_tile INT, orbit_pass STRING, area_per_acq_group_km2 INT, n_bursts_per_acq_group INT"
BURSTS = f"jpl_burst_id STRING, track_number INT, acq_group_id INT, mgrs_tile_id STRING, bbox {BBOX}"
TILES = f"mgrs_tile_id STRING, utm_epsg INT, utm_wkt STRING, bbox {BBOX}"
CELLS = "store_id STRING, t TIMESTAMP_NTZ, month STRING, block_y INT, block_x INT, row INT, col INT, track INT, scene_id LONG, vv FLOAT, vh FLOAT"
ITEMS = f"id STRING, collection STRING, datetime TIMESTAMP, tile STRING, orbit_state STRING, epsg INT, bbox {BBOX}, assets MAP<STRING, STRUCT<href: STRING>>"
SOURCE_LINKS = "output_id STRING, source_id STRING, generation STRING, variable STRING, role STRING"


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def read_strict(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table whose columns must be those of the schema; missing, further or differently typed columns are an error."""
    want, found = schema(ddl), spark.read.parquet(path).schema
    differ = {(f.name, f.dataType.simpleString()) for f in want} ^ {(f.name, f.dataType.simpleString()) for f in found}
    if differ:
        raise ValueError(f"{path} is not of the expected schema: {sorted(differ)}")
    return spark.read.schema(want).parquet(path)


def read_projected(spark: SparkSession, path: str, ddl: str, keys: dict[str, Sequence] | None = None) -> DataFrame:
    """The schema's columns of a table; those that are not there are NULL. keys are pushed down as IN lists; no row is an error."""
    found = spark.read.parquet(path)
    for key, values in (keys or {}).items():
        found = found.where(F.col(key).isin(list(values)))
    out = found.select(*[F.col(f.name).cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(ddl)])
    if keys and out.isEmpty():
        raise LookupError(f"no row of {path} has {keys}")
    return out


def read_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], block: int) -> DataFrame:
    """Cells of a window of a cube: blocks that miss it are pruned as partitions, the rest by the cells' own places."""
    c = spark.read.parquet(path)
    c = c.where(F.col("block_y").between(rows[0] // block, (rows[1] - 1) // block) & F.col("block_x").between(cols[0] // block, (cols[1] - 1) // block))
    return c.where((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))


def geojson_boxes(texts: DataFrame, column: str = "value") -> DataFrame:
    """Bounding boxes of the polygon features of GeoJSON texts, one a feature."""
    kind = "STRUCT<features: ARRAY<STRUCT<id: STRING, geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>>>>"
    f = texts.select(F.explode(F.from_json(column, kind)["features"]).alias("f")).where("f.geometry.type = 'Polygon'")
    along = lambda k: F.transform(F.flatten("f.geometry.coordinates"), lambda p: p[k])
    return f.select(F.col("f.id").alias("id"), F.array_min(along(0)).alias("xmin"), F.array_min(along(1)).alias("ymin"), F.array_max(along(0)).alias("xmax"), F.array_max(along(1)).alias("ymax"))


def xml_fields(texts: DataFrame, paths: dict[str, str], column: str = "value") -> DataFrame:
    """Fields of XML texts by XPath; a text without one gives NULL."""
    return texts.select(*[F.nullif(F.xpath_string(F.col(column), F.lit(p)), F.lit("")).alias(n) for n, p in paths.items()])


def band_rasters(spark: SparkSession, glob: str, height: int, width: int, nodata: float = -9999.0) -> DataFrame:
    """Raw float32 rasters of a known shape, one file a scene, as (path, values, error): decoding never fails the job."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")

    @F.pandas_udf("STRUCT<values: ARRAY<FLOAT>, error: STRING>")
    def decode(content: pd.Series) -> pd.DataFrame:
        out = []
        for raw in content:
            if len(raw) != 4 * height * width:
                out.append((None, "not_a_raster"))
                continue
            a = np.frombuffer(raw, "<f4").astype(object)
            a[(np.frombuffer(raw, "<f4") == nodata) | ~np.isfinite(np.frombuffer(raw, "<f4"))] = None
            out.append((a.tolist(), None))
        return pd.DataFrame(out, columns=["values", "error"])

    return files.select("path", decode("content").alias("r")).select("path", "r.*")


def paired_scenes(copol: DataFrame, crosspol: DataFrame, key: str = "scene_id", most_failed: float = 0.5) -> DataFrame:
    """Scenes of which both bands decoded. Files that are not there do not count towards the share of failures, which is checked."""
    both = copol.select(key, F.col("values").alias("vv"), F.col("error").alias("e1")).join(crosspol.select(key, F.col("values").alias("vh"), F.col("error").alias("e2")), key)
    counted = both.where("coalesce(e1, '') <> 'not_found' AND coalesce(e2, '') <> 'not_found'")
    share = counted.agg((F.count_if(F.col("e1").isNotNull() | F.col("e2").isNotNull()) / F.count("*")).alias("s")).first()["s"]
    if share is not None and share > most_failed:
        raise RuntimeError(f"{share:.0%} of the scenes could not be read")
    return both.where("e1 IS NULL AND e2 IS NULL").drop("e1", "e2")


RASTER_MARK = b"GLR1"


def as_rasters(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """(key, content): each array as a raster file: a mark, height and width as 32-bit numbers, then 32-bit floats, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, at = column.flatten().to_numpy(zero_copy_only=False).astype("<f4"), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            body = [RASTER_MARK + np.array([(b - a) // width, width], "<i4").tobytes() + flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary())], names=[key, "content"])

    return df.where(F.col(values).isNotNull()).select(key, F.col(values).cast("array<float>")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, content binary")


def decode_rasters(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, height, width, values, error) of raster files. A file that cannot be read has an error class and no values:
    missing, not_a_raster or truncated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heights, widths, values, errors = [], [], [], []
            for raw in batch.column(1).to_pylist():
                error = "missing" if raw is None else "not_a_raster" if raw[:4] != RASTER_MARK or len(raw) < 12 else None
                h, w = np.frombuffer(raw, "<i4", 2, 4).tolist() if error is None else (0, 0)
                if error is None and len(raw) != 12 + 4 * h * w:
                    error = "truncated"
                heights.append(None if error else h)
                widths.append(None if error else w)
                values.append(None if error else np.frombuffer(raw, "<f4", h * w, 12))
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heights, pa.int32()), pa.array(widths, pa.int32()), pa.array(values, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[key, "height", "width", "values", "error"])

    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, height int, width int, values array<float>, error string")
