"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames.

Every step is a grouped minimum and a join on a node, so a node with very many links is pre-aggregated and its join
is one that Spark can split. Each round is written to the shared folder, which cuts lineage. The number of links
never grows: each round replaces a link by one to a smaller node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop, save

_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the same components as the links a-b: each node that is not its component's least, and that least."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, before[x], least)
        np.minimum.at(label, before[y], least)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 4_000_000:
            a, b = forest(a, b)
            if len(a) > 2_000_000:  # no longer shrinks: send it on
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_LINK)
                a, b = a[:0], b[:0]
    if len(a):
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_LINK)


def components(links: DataFrame) -> DataFrame:
    """From links (a, b), longs: one row (node, component) a node that is not its component's least; the least is its id.

    Null ends are ignored, repeated and self links too; no link gives no row.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_contract, "a long, b long")
    links = save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: a node's larger neighbours go to its least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = save(large, "large")
        # small star: a node's smaller neighbours, and itself, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        done = save(small, "small")
        drop(large)
        # stars: no node is both an end and a centre, and each has one centre
        ends = done.groupBy("a").agg(F.count("*").alias("n"))
        centres = done.select(F.col("b").alias("a")).distinct()
        open_ = ends.where("n > 1").select("a").unionByName(ends.join(centres, "a", "left_semi").select("a"))
        drop(links)
        links = done
        if open_.isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
