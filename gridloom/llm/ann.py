"""Nearest neighbours by inner product: a block matrix join over int8 tiles with error bounds.

Queries are dealt into blocks of QUERY_BLOCK, candidates into groups of about GROUP vectors. A task gets a block and a
group, both of bounded size, whatever the tables' sizes; blocks times groups run as one job a wave. Vectors are quantised
to int8 with a scale each. A tile's int8 product estimates the inner products; with residual norms |a - a'| and |b - b'|
an estimate is off by at most |a'||b - b'| + |a - a'||b|. A pair survives if its upper bound reaches the query's floor.
Survivors are computed again from the original vectors, in double precision and in order of the components, and go to a
heap a query; tasks send their heaps, which a window merges. The result is exact.

Candidates come in waves, by a hash of id and row: the first has GROUP vectors, each further one as many as all before it.
A query's floor, its k-th best score so far, goes into the next wave, so that a wave sends about k more rows a query,
however many tasks it has, and waves grow with the logarithm of the table. The work is that of all queries times all
vectors, as exactness asks; a group's vectors are read once a block.

Defined cases: vectors that are null, empty or zero, or hold a null or non-finite component, take no part; vectors of
another length than the query's are no candidates. Ties go to the smaller id. Rows with the same id are candidates
each, but none for a query of that id; a query id that has several vectors answers for the smallest of them (by its
components). An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import drop, save, tune

#: Queries and candidates that a task holds: at 64 components, 1 and 4 MB.
QUERY_BLOCK = 2048
GROUP = 8192
TILE = 2048
_PLACES = 1 << 30

_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Quantised:
    """Vectors of one length with their int8 forms, scales, norms and residual norms."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.scale = np.abs(vectors).max(1) / 127
        self.codes = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.near = np.sqrt((near**2).sum(1))
        self.rest = np.sqrt(((vectors - near) ** 2).sum(1))
        self.norm = np.sqrt((vectors**2).sum(1))


def tile_bounds(a: Quantised, b: Quantised, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of a with b[low:high], and the most that each may be off."""
    # sums of products of int8 are whole numbers under 2**24 for up to 1040 components: float32 holds them
    kind = np.float32 if a.codes.shape[1] <= 1040 else np.float64
    product = (a.codes.astype(kind) @ b.codes[low:high].astype(kind).T).astype(np.float64)
    estimate = product * a.scale[:, None] * b.scale[None, low:high]
    off = a.near[:, None] * b.rest[None, low:high] + a.rest[:, None] * b.norm[None, low:high]
    return estimate, off * (1 + 1e-9) + 1e-12 * a.norm[:, None] * b.norm[None, low:high]


def in_order_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up in order of the components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _by_width(ids: pa.ChunkedArray, vectors: pa.ChunkedArray, *more: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, ...]]:
    """Ids, vectors as a matrix, and further columns, by the vectors' length."""
    column = vectors.combine_chunks()
    length, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(length) - length
    columns = [c.to_numpy() for c in (ids, *more)]
    out = {}
    for width in np.unique(length).tolist():
        spot = np.flatnonzero(length == width)
        matrix = flat[begin[spot][:, None] + np.arange(width)[None, :]].astype(np.float64)
        out[width] = (columns[0][spot], matrix, *(c[spot] for c in columns[1:]))
    return out


def search(names: np.ndarray, asked: np.ndarray, floor: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, tile: int = TILE) -> dict[int, list[tuple[float, int]]]:
    """The k best candidates of each query, by heaps of (score, -id), among those that score floor or more."""
    block, other = Quantised(asked), Quantised(vectors)
    heaps: dict[int, list[tuple[float, int]]] = defaultdict(list)
    floor = floor.copy()
    for low in range(0, len(ids), tile):
        high = min(low + tile, len(ids))
        estimate, off = tile_bounds(block, other, low, high)
        no = names[:, None] == ids[None, low:high]
        if high - low >= k:
            least = np.where(no, -np.inf, estimate - off)
            floor = np.maximum(floor, np.partition(least, high - low - k, axis=1)[:, high - low - k])
        q, c = np.nonzero((estimate + off >= floor[:, None]) & ~no)
        score = in_order_dot(block.vectors[q], other.vectors[low + c])
        able = score >= floor[q]
        for a, s, i in zip(q[able].tolist(), score[able].tolist(), ids[low + c[able]].tolist(), strict=True):
            heap = heaps[a]
            if len(heap) < k:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                heapq.heapreplace(heap, (s, -i))
        for a, heap in heaps.items():
            if len(heap) == k:
                floor[a] = max(floor[a], heap[0][0])
    return heaps


def _meet(k: int):
    def run(block: pa.Table, group: pa.Table) -> pa.Table:
        names, found, scores = [], [], []
        if block.num_rows and group.num_rows:
            others = _by_width(group.column("vec_id"), group.column("vector"))
            for width, (own, asked, floor) in _by_width(block.column("query_id"), block.column("query"), block.column("floor")).items():
                if width in others:
                    for a, heap in search(own, asked, floor, *others[width], k).items():
                        for s, i in sorted(heap, reverse=True):
                            names.append(int(own[a]))
                            found.append(-i)
                            scores.append(s)
        return pa.table([pa.array(names, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], schema=_HIT)

    return run


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    v: Column = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def waves(rows: int, group: int) -> list[tuple[int, int, int]]:
    """Waves over the places 0 .. _PLACES - 1 that rows are hashed to: first and last place + 1, and the number of groups."""
    upto = [_PLACES]
    while rows * upto[-1] / _PLACES > group:
        upto.append(upto[-1] // 2)
    upto = [0, *reversed(upto)]
    return [(a, b, max(1, round(rows * (b - a) / _PLACES / group))) for a, b in zip(upto[:-1], upto[1:], strict=True)]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, group: int = GROUP) -> DataFrame:
    """One row a query and neighbour: query_id, rank, vec_id, score. is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    tune(spark)
    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(_PLACES))  # rows of one id spread as well
    all_ = save(usable_vectors(vectors, id_col, vector_col).withColumn("place", place), "vectors")
    asked = save(all_.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("query")).withColumnRenamed("vec_id", "query_id"), "queries")
    rows, blocks = all_.count(), -(-asked.count() // query_block)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    best: DataFrame | None = None
    for first, last, groups in waves(rows, group):
        if best is None:
            now = asked.withColumn("floor", F.lit(float("-inf")))
        else:
            floors = best.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
            now = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        left = now.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = all_.where((F.col("place") >= first) & (F.col("place") < last)).withColumn("grp", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        hits = left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInArrow(_meet(k), "query_id long, vec_id long, score double")
        hits = hits if best is None else hits.unionByName(best.drop("rank"))
        old, best = best, save(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        if old is not None:
            drop(old)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
