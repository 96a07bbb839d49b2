"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in order of id, then size and checksum. A generalised Feistel network permutes a grid of rows and
columns that just holds the numbers; a number that lands outside walks on until it lands inside. How long the longest
walk is follows from the outside cells alone, fewer than the grid's side, so the walk is a fixed expression. Place p
of the shuffle is slot p div shards of shard p mod shards: both are computable from the number, and shard sizes differ
by one at most. All of it is DataFrame arithmetic.

Defined cases: null text counts no byte. Null ids sort first. Repeated rows get numbers of their own. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop, partitions, save

#: Fixed values of the round function: a prime under 2**31 and, for each round, three factors under it.
PRIME = 2147483647
ROUNDS = ((1103515245, 12345, 48271), (69621, 982451653, 16807), (1664525, 1013904223, 39373), (22695477, 305419896, 742938285), (1566083941, 271828182, 950706376), (630360016, 314159265, 1226874159))


def _mix(value: Column, key: tuple[int, int, int], seed: int) -> Column:
    a, b, c = key
    x = F.pmod(value * F.lit(a).cast("long") + F.lit(b + seed).cast("long"), F.lit(PRIME))
    return F.pmod(F.pmod(x * x, F.lit(PRIME)) * F.lit(c).cast("long") + x, F.lit(PRIME))


def _round(key: tuple[int, int, int], seed: int, side: int, width: int, left: bool):
    def turn(s: Column) -> Column:
        l, r = s["l"], s["r"]
        if left:
            return F.struct(F.pmod(l + _mix(r, key, seed), F.lit(side).cast("long")).alias("l"), r.alias("r"))
        return F.struct(l.alias("l"), F.pmod(r + _mix(l, key, seed), F.lit(width).cast("long")).alias("r"))

    return turn


def permuted(number: Column, side: int, width: int, seed: int) -> Column:
    """One pass of the network over 0 .. side * width - 1: halves (number div width, number mod width) take turns.

    The halves ride in a struct from lambda to lambda, so that the expression stays small.
    """
    state = F.struct(F.floor((number - F.pmod(number, F.lit(width).cast("long"))) / F.lit(width)).cast("long").alias("l"), F.pmod(number, F.lit(width).cast("long")).alias("r"))
    for k, key in enumerate(ROUNDS):
        state = F.element_at(F.transform(F.array(state), _round(key, seed, side, width, k % 2 == 0)), 1)
    return F.element_at(F.transform(F.array(state), lambda s: s["l"] * F.lit(width).cast("long") + s["r"]), 1)


def grid(rows: int) -> tuple[int, int]:
    side = max(1, math.isqrt(rows))
    return side, max(1, -(-rows // side))


def walk_length(spark, rows: int, seed: int) -> int:
    """Most passes that a number under `rows` needs; cells outside are fewer than the grid's side."""
    side, width = grid(rows)
    outside = spark.range(rows, side * width).select(F.col("id").alias("at"))
    passes = 1
    while side * width > rows:
        outside = save(outside.select(permuted(F.col("at"), side, width, seed).alias("at")).where(F.col("at") >= rows), "walk")
        passes += 1
        if outside.isEmpty():
            break
    return passes


def shuffled(number: Column, rows: int, seed: int, passes: int) -> Column:
    side, width = grid(rows)
    place = permuted(number, side, width, seed)
    for _ in range(passes - 1):
        place = F.element_at(F.transform(F.array(place), lambda x: F.when(x < rows, x).otherwise(permuted(x, side, width, seed))), 1)
    return place


def numbered(rows: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Rows with their global number from 0 in the given order, and how many there are.

    A range exchange sorts; counts of its partitions, one row each, give the partitions their offsets.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = save(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part, inner = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "_part long, _start long")  # a row a partition
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, inner + F.col("_start")).drop("_at", "_part", "_start"), total


def shard(docs: DataFrame, shards: int = 24, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `rows`)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    slim = save(slim, "sizes")
    rows, total = numbered(slim, ["doc_id", "size", "text_crc32"])
    place = shuffled(F.col("row_number"), max(total, 1), seed, walk_length(docs.sparkSession, max(total, 1), seed))
    out = rows.withColumn("place", place)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
