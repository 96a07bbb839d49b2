"""Structured Streaming forms of the cube's incremental behaviour. Each runs on what is there now and ends."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared one; a local one only where the session names none and runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import atexit
        import shutil
        import tempfile

        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="gridloom-stream-")
            atexit.register(shutil.rmtree, _OWN["dir"], True)
        base = _OWN["dir"]
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream(spark: SparkSession, path: str, batches: int = 3) -> DataFrame:
    """A parquet table as a stream that arrives in `batches` micro-batches: its rows are dealt to as many files first."""
    at = f"{scratch(spark)}/arriving"
    df = spark.read.parquet(path)
    df.repartition(batches).write.parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


def collect_appends(df: DataFrame) -> DataFrame:
    """Run an append-mode stream to its end; the rows it wrote."""
    spark, at = df.sparkSession, scratch(df.sparkSession)
    df.writeStream.format("parquet").option("checkpointLocation", f"{at}/log").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def run_batches(df: DataFrame, step: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    at = scratch(df.sparkSession)
    df.writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def append_new_steps(steps: DataFrame, key: list[str], store: DataFrame | None = None) -> DataFrame:
    """The rows that are appended: one a key that neither the store nor an earlier batch has.

    Keys of earlier batches are the query's state, so that no batch reads what was appended before; the store as it was at
    the start, a static table, is an anti-join.
    """
    if store is not None:
        steps = steps.join(store.select(*key).distinct(), key, "left_anti")
    return collect_appends(steps.dropDuplicates(key))


def rejected_late(df: DataFrame, time: str, days: int = 30) -> DataFrame:
    """Rows with cause: recoverable if at most `days` older than the newest row of all batches so far, else permanent.

    A batch leaves its rows and its newest time; the cause is told on reading, so it does not depend on the batches.
    """
    spark, at = df.sparkSession, scratch(df.sparkSession)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")
        batch.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{at}/newest/batch={number}")

    run_batches(df, step)
    newest = spark.read.parquet(f"{at}/newest").agg(F.max("newest").alias("_newest"))  # a row a batch
    old = F.timestamp_diff("MICROSECOND", F.col(time), F.col("_newest")) > days * 86_400_000_000
    return spark.read.parquet(f"{at}/rows").drop("batch").join(F.broadcast(newest)).withColumn("cause", F.when(old, "permanent").otherwise("recoverable")).drop("_newest")


def monthly_counts(df: DataFrame, time: str) -> DataFrame:
    """Calendar months are no fixed windows: group by the truncated date. The table of the last update of each month."""
    spark, at = df.sparkSession, f"{scratch(df.sparkSession)}/months"
    counts = df.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    run_batches(counts, lambda batch, number: batch.write.mode("overwrite").parquet(at), "complete")
    return spark.read.schema(counts.schema).parquet(at)


def footprints(df: DataFrame, track: str, burst: str) -> DataFrame:
    """Each track's growing set of bursts, as the rows that made it grow. State is a set of a track's bursts."""

    def grow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = set(state.get[0]) if state.exists else set()
        new = {b for f in frames for b in f[burst]} - known
        state.update((sorted(known | new),))
        yield pd.DataFrame({track: [key[0]] * len(new), burst: sorted(new)})

    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    out = df.select(track, burst).groupBy(track).applyInPandasWithState(grow, f"{track} {kind[track]}, {burst} {kind[burst]}", f"seen array<{kind[burst]}>", "append", "NoTimeout")
    return collect_appends(out)


def distinct_steps(df: DataFrame, keys: list[str], time: str, delay: str = "40 days") -> DataFrame:
    """One row a key within the watermark."""
    return collect_appends(df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys))
