"""Session settings that the engine's plans assume."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that hold at any scale; the cluster's own values for memory and parallelism are left alone.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; where it is installed this changes nothing."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, have)))


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
