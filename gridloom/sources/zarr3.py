"""Zarr v3 arrays as DataFrames, by Spark's own file readers: metadata as whole text, chunks as binary files.

A chunk is a row of the file scan, so chunks spread over the tasks and any store that Spark reads will do. Codecs:
bytes (little or big endian) and zstd. A chunk that is not there holds fill values only and gives no row: absent is NULL.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def metadata(spark: SparkSession, path: str) -> dict:
    """The array's zarr.json."""
    return json.loads(spark.read.text(f"{path}/zarr.json", wholetext=True).first()[0])


def _decode(meta: dict):
    dims, chunk = len(meta["shape"]), meta["chunk_grid"]["configuration"]["chunk_shape"]
    fill = meta.get("fill_value")
    dtype = np.dtype(meta["data_type"])
    codecs = [c["name"] for c in meta["codecs"]]
    order = next((c.get("configuration", {}).get("endian", "little") for c in meta["codecs"] if c["name"] == "bytes"), "little")
    unknown = set(codecs) - {"bytes", "zstd"}
    if unknown:
        raise ValueError(f"codecs that are not read: {sorted(unknown)}")
    wire = dtype.newbyteorder("<" if order == "little" else ">")
    skip = np.nan if fill in ("NaN", None) else fill

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(content) if "zstd" in codecs else content
                a = np.frombuffer(raw, wire).reshape(chunk).astype(float)
                at = [int(p) * c for p, c in zip(path.rsplit("/c/", 1)[1].split("/"), chunk, strict=True)] if dims else []
                where = np.indices(chunk).reshape(dims, -1) + np.array(at)[:, None]
                keep = (where < np.array(meta["shape"])[:, None]).all(0) & ~np.isnan(a.ravel()) & (a.ravel() != skip)
                yield pa.RecordBatch.from_arrays([*(pa.array(w[keep], pa.int64()) for w in where), pa.array(a.ravel()[keep], pa.float64())], names=[*(f"i{d}" for d in range(dims)), "value"])

    return run


def read_array(spark: SparkSession, path: str, first_dim: Sequence[int] | None = None) -> DataFrame:
    """Cells (i0, i1, ..., value) of an array; first_dim lists the places along the first dimension that are wanted, which prunes files."""
    meta = metadata(spark, path)
    dims = len(meta["shape"])
    globs = [f"{path}/c/" + "/".join(["*"] * dims)]
    if first_dim is not None:
        size = meta["chunk_grid"]["configuration"]["chunk_shape"][0]
        globs = [f"{path}/c/{k}/" + "/".join(["*"] * (dims - 1)) for k in sorted({i // size for i in first_dim})]
    files = spark.read.format("binaryFile").load(globs).select("path", "content")
    cells = files.mapInArrow(_decode(meta), ", ".join(f"i{d} long" for d in range(dims)) + ", value double")
    return cells.where(F.col("i0").isin(list(first_dim))) if first_dim is not None else cells


def array_metadata(shape: Sequence[int], chunks: Sequence[int], dtype: str = "float32") -> str:
    """zarr.json of an array with zstd chunks and NaN as fill value."""
    return json.dumps({
        "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN", "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 7, "checksum": False}}], "attributes": {},
    })
