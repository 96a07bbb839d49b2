"""Phase logs: lines of `[PHASE] name EVENT k=v ...` as rows, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = r"\[PHASE\]\s+(\S+)\s+(START|END|FAILED)\b\s*(.*)$"


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """(name, event, fields) of the lines that are phase lines."""
    c = F.col(line)
    pairs = F.filter(F.split(F.regexp_extract(c, _LINE, 3), r"\s+"), lambda p: p.contains("="))
    entries = F.transform(pairs, lambda p: F.struct(F.element_at(F.split(p, "=", 2), 1).alias("k"), F.element_at(F.split(p, "=", 2), 2).alias("v")))
    # of a key that comes twice the last counts
    fields = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    return lines.where(c.rlike(_LINE)).select(F.regexp_extract(c, _LINE, 1).alias("name"), F.regexp_extract(c, _LINE, 2).alias("event"), fields.alias("fields"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def _number(field: str) -> Column:
    return F.regexp_extract(F.coalesce(F.try_element_at("fields", F.lit(field)), F.lit("")), r"^(-?[0-9.]+)", 1).try_cast("double")


def summarize(records: DataFrame) -> DataFrame:
    """By tile and phase: count, seconds, peak memory, largest growth, failures. START lines do not count."""
    r = records.where("event <> 'START'").select(F.try_element_at("fields", F.lit("tile")).alias("tile"), F.col("name").alias("phase"), _number("elapsed").alias("elapsed"), _number("rss").alias("rss"), _number("delta").alias("delta"), (F.col("event") == "FAILED").alias("failed"))
    return r.groupBy("tile", "phase").agg(F.count("*").alias("n"), F.round(F.sum("elapsed"), 6).alias("elapsed"), F.max("rss").alias("max_rss"), F.max("delta").alias("max_delta"), F.count_if("failed").alias("n_failed"))
