"""Near-duplicates by 64-bit fingerprints: a self-join of binary tries under a Hamming error budget.

The distinct fingerprints go into tries, one for each value of certain pairs of bit blocks: two fingerprints within
the budget agree on such a pair (see block_pairs), so they meet in a trie. A trie is a sorted array; a node is a range of it. The join
walks pairs of nodes bit by bit, all pairs of a level at once, adds up the bits in which the two branches differ and
drops a pair whose sum passes the budget. A trie's links come out as a spanning forest: pairs whose nodes lie in one
known component are dropped too, so a large group of near copies costs no square of its size. A trie of very many
fingerprints is first dealt again, by blocks of its other bits, which loses no link.

Defined cases: null and empty texts have fingerprint zero and link like any other. Repeated rows share fingerprint
and component. A null id keeps its row and never is a component's id unless no other exists. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import partitions, save, spread_join, texts_bytes, tune
from gridloom.llm.components import components, forest

BITS = 64
#: A trie of more fingerprints is dealt again over the tasks.
TRIE_ROWS = 4_000
#: One in so many prints decides which tries are heavy.
SAMPLE_SHARE = 16
#: Heavy tries that are broadcast at most, 16 bytes each; more are joined.
HEAVY_BROADCAST = 100_000
#: Node pairs that are walked at a time.
_FRONT = 1 << 18
_SEED = 42

_PRINT = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_STAR = pa.schema([*_LINK, ("space", pa.int32()), ("trie", pa.int64())])


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, ASCII lower-cased and joined by a space; of all words if they are fewer."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, _SEED)], np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], _SEED) for a, b in zip(start, end[words - 1 :].tolist(), strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64 bits; a bit is set where over half of the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[low : low + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            out = []
            for text in texts_bytes(batch.column(1)):
                if text not in seen:
                    seen[text] = fingerprint(shingle_hashes(text, words))
                out.append(seen[text])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.int64())], schema=_PRINT)

    return run


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print) of every row, print as a signed long."""
    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_prints(words), "doc_id long, print long")


def _blocks(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """n runs of the bits low..high-1: (shift, width)."""
    cut = [low + (high - low) * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _slice(column: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else column


def block_pairs(budget: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Pairs of bit blocks on one of which any two prints within the budget agree.

    Of budget + 3 blocks at least three agree; the blocks form two groups, so one group has two that agree.
    """
    blocks = _blocks(0, BITS, budget + 3)
    half = (len(blocks) + 1) // 2
    return [(x, y) for group in (blocks[:half], blocks[half:]) for i, x in enumerate(group) for y in group[i + 1 :]]


def _packed(column: Column, runs: list[tuple[int, int]]) -> Column:
    """The bits of some runs, side by side."""
    out, at = F.lit(0).cast("long"), 0
    for shift, width in runs:
        out = out.bitwiseOR(F.shiftleft(_slice(column, shift, width), at))
        at += width
    return out


def trie_links(prints: DataFrame, budget: int, trie_rows: int = TRIE_ROWS, stars: bool = False) -> DataFrame:
    """From (node, space, print), one row a space and print: links (a, b) of nodes that connect all prints of a space
    within `budget` bits, as forests. With `stars` also the space and the trie of each link: (a, b, space, trie).

    A link is an end of a star and its centre, which themselves may lie further apart than `budget` bits.

    Which tries are dealt again is decided by the rows of a sample, a share of the prints by their hash; both ways find
    the same links, so the sample steers the plan alone.
    """
    spark = prints.sparkSession
    p, space = F.col("print"), F.col("space")
    pairs = block_pairs(budget)
    tries = F.array(*[F.xxhash64(space, F.lit(k), _packed(p, list(pair))) for k, pair in enumerate(pairs)])
    more = ["space"] if stars else []
    rows = prints.select("node", "space", "print", F.posexplode(tries).alias("block", "trie"))
    sample = rows.where(F.pmod(F.xxhash64("print", F.lit(1)), F.lit(SAMPLE_SHARE)) == 0)
    heavy = save(sample.groupBy("trie").count().where(F.col("count") * SAMPLE_SHARE > trie_rows).select("trie", F.lit(True).alias("heavy")), "heavy")
    many = heavy.count()
    if many:
        again = []
        for k, (x, y) in enumerate(pairs):
            # the bits outside the pair, as budget + 1 blocks on one of which two prints within the budget agree
            rest = [(0, x[0]), (x[0] + x[1], y[0] - x[0] - x[1]), (y[0] + y[1], BITS - y[0] - y[1])]
            packed = _packed(p, [r for r in rest if r[1]])
            second = [F.xxhash64("trie", F.lit(i), _slice(packed, *b)) for i, b in enumerate(_blocks(0, BITS - x[1] - y[1], budget + 1))]
            again.append(F.when(F.col("block") == k, F.array(*second)))
        rows = rows.join(F.broadcast(heavy) if many <= HEAVY_BROADCAST else heavy, "trie", "left")
        rows = rows.select("node", "print", *more, F.explode(F.when(F.col("heavy"), F.coalesce(*again)).otherwise(F.array("trie"))).alias("trie"))
    dealt = rows.select("node", "print", "trie", *more).repartition(partitions(spark), "trie").sortWithinPartitions("trie", "print")
    return dealt.mapInArrow(_join(budget, stars), "a long, b long" + (", space int, trie long" if stars else "")).distinct()


def _join(budget: int, stars: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out(ready: pa.Table) -> Iterator[pa.RecordBatch]:
            node, value, trie = (ready.column(c).to_numpy() for c in ("node", "print", "trie"))
            a, b = join_tries(value.view(np.uint64), np.flatnonzero(np.concatenate([[True], trie[1:] != trie[:-1]])), budget)
            if len(a) and stars:
                space = ready.column("space").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(space[a], pa.int32()), pa.array(trie[a])], schema=_STAR)
            elif len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], schema=_LINK)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 19:  # whole tries go, the last one waits for its rest
                table = pa.Table.from_batches(held)
                trie = table.column("trie").to_numpy()
                cut = int(np.flatnonzero(np.concatenate([[True], trie[1:] != trie[:-1]]))[-1])
                if cut:
                    yield from out(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), table.num_rows - cut
        if size:
            yield from out(pa.Table.from_batches(held))

    return run


def join_tries(value: np.ndarray, first: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as places) within each trie: value is sorted (as signed) inside each run that `first` begins.

    The order inside a run is turned into the unsigned one by flipping the sign bit, which changes no distance.
    """
    v = value ^ np.uint64(1 << 63)
    n = len(v)
    label = np.arange(n)  # least place of the component so far
    ends = np.append(first[1:], n)
    many = ends - first > 1
    lo, hi = first[many], ends[many]
    # a front: node pairs (ranges p and q), their level's bit and the bits that differ so far
    stack = []
    for k in range(0, len(lo), _FRONT):
        a, b = lo[k : k + _FRONT], hi[k : k + _FRONT]
        stack.append((BITS - 1, a, b, a, b, np.zeros(len(a), np.int64)))
    while stack:
        bit, pl, ph, ql, qh, diff = stack.pop()
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])]) if n else label
        known = (label[pl] == label[ql]) & (change[ph - 1] == change[pl]) & (change[qh - 1] == change[ql])
        keep = ~known
        pl, ph, ql, qh, diff = (x[keep] for x in (pl, ph, ql, qh, diff))
        # pairs of single fingerprints are decided at once
        leaf = (ph - pl == 1) & (qh - ql == 1)
        if leaf.any():
            a, b = pl[leaf], ql[leaf]
            near = (np.bitwise_count(v[a] ^ v[b]) <= budget) & (a != b)
            _unite(label, a[near], b[near])
            pl, ph, ql, qh, diff = (x[~leaf] for x in (pl, ph, ql, qh, diff))
        if not len(pl) or bit < 0:
            if len(pl):  # equal prints to the last bit
                _unite(label, pl, ql)
            continue
        pm, qm = _middle(v, pl, ph, bit), _middle(v, ql, qh, bit)
        same = (pl == ql) & (ph == qh)
        kids = [
            (pl, pm, ql, qm, diff, np.ones(len(pl), bool)),
            (pm, ph, qm, qh, diff, np.ones(len(pl), bool)),
            (pl, pm, qm, qh, diff + 1, np.ones(len(pl), bool)),
            (pm, ph, ql, qm, diff + 1, ~same),
        ]
        parts = []
        for a, b, c, d, e, ok in kids:
            ok = ok & (b > a) & (d > c) & (e <= budget)
            ok &= ~((a == c) & (b == d) & (b - a == 1))  # a fingerprint with itself
            parts.append(tuple(x[ok] for x in (a, b, c, d, e)))
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        # pairs far apart go on the stack first: near ones are joined, and prune, before them
        order = np.argsort(-nxt[4], kind="stable")
        nxt = [x[order] for x in nxt]
        for k in range(0, len(order), _FRONT):
            stack.append((bit - 1, *(x[k : k + _FRONT] for x in nxt)))
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _middle(v: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where the node's upper branch begins: the first print with the bit set; a node's prints agree above it."""
    a, b = low.copy(), high.copy()
    one = np.uint64(1 << bit)
    while True:
        open_ = np.flatnonzero(a < b)
        if not len(open_):
            return a
        mid = (a[open_] + b[open_]) // 2
        up = (v[mid] & one) != 0
        b[open_] = np.where(up, mid, b[open_])
        a[open_] = np.where(up, a[open_], mid + 1)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    if len(a):
        x, y = label[a], label[b]
        apart = x != y
        if apart.any():
            node, least = forest(x[apart], y[apart])
            to = np.arange(len(label))
            to[node] = least
            label[:] = to[label]


def near_groups(prints: DataFrame, budget: int = 4) -> DataFrame:
    """From (doc_id, print), a saved table: (doc_id, print, component_id), the smallest doc_id that links of `budget` bits reach."""
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    links = trie_links(nodes.select(F.col("print").alias("node"), F.lit(0).alias("space"), "print"), budget)
    groups = components(links.select("a", "b"))
    nodes = save(nodes.join(groups.withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("component", "print").alias("component")), "nodes")
    first = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = spread_join(nodes, first, "component").select("print", "component_id")
    return spread_join(prints, named, "print").select("doc_id", "print", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = save(fingerprints(docs, words, id_col, text_col), "prints")
    return near_groups(prints, budget).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
