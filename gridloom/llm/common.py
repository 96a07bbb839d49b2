"""Shared plumbing of the text operators: the shared scratch folder, Arrow access to texts, session tuning."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import share_code

_OWN_DIR: dict[str, str] = {}

#: Batches to Python are held to this many bytes, whatever the length of the texts.
BATCH_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Let workers import the package, and bound the Arrow batches by bytes as well as rows, unless the session's bound is lower."""
    share_code(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 28)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app not in _OWN_DIR:
            _OWN_DIR[app] = tempfile.mkdtemp(prefix="gridloom-")
            atexit.register(_remove_local, _OWN_DIR[app])
            spark.sparkContext.setCheckpointDir(_OWN_DIR[app])
        base = _OWN_DIR[app]
    return f"{base.rstrip('/')}/gridloom-{app}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the table read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As save, dealt into buckets of key, so that later joins on key leave this side where it is."""
    spark = df.sparkSession
    table = f"gl_{name}_{uuid.uuid4().hex}"
    (
        df.write.format("parquet")
        .option("compression", "zstd")
        .option("path", f"{shared_dir(spark)}/{table}")
        .bucketBy(partitions(spark), key)
        .saveAsTable(table)
    )
    return spark.table(table)


def drop(df: DataFrame) -> None:
    """Delete a table that save() or save_bucketed() wrote, once nothing lazy needs it."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        if (name := folder.rpartition("/")[2]).startswith("gl_"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def spread_join(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined on keys to right, which has a row a key; a key with more rows of left than a task's fair share is dealt
    over several tasks, and its row of right goes to each of them.

    Fewer keys than tasks can exceed the fair share, so the list of them that is broadcast is bounded by the number of
    partitions. left should be a saved table: it is counted by key first, unless counts (the keys and n) are given. Its
    columns `_salt` and `_salts`, if there are any, stay apart from the ones made here.
    """
    keys = [keys] if isinstance(keys, str) else keys
    tasks = partitions(left.sparkSession)
    counts = counts if counts is not None else left.groupBy(*keys).agg(F.count("*").alias("n"))
    share = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // tasks)
    known = [F.col(k).isNotNull() for k in keys]
    hot = counts.where(F.col("n") > share).where(reduce(and_, known)).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("n")).collect()
    if not hot:
        return left.join(right, keys, how)
    salt, most = fresh(left, "_salt"), fresh(left, "_salts")
    table = F.broadcast(left.sparkSession.createDataFrame([tuple(r) for r in hot], T.StructType([*(left.schema[k] for k in keys), T.StructField(most, T.IntegerType())])))
    dealt = left.join(table, keys, "left").withColumn(salt, F.when(F.col(most).isNull(), 0).otherwise(F.floor(F.rand(1) * F.col(most)).cast("int"))).drop(most)
    copies = right.join(table, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(most), F.lit(1)) - 1))).drop(most)
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets into them; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def texts_bytes(array: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes."""
    data, at = utf8(array)
    raw = data.tobytes()
    at = at.tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def rows(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema
    )


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows of a partition that is sorted by key, one key's rows at a time."""
    now: object = None
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held
