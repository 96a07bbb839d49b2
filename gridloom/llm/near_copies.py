"""Near copies by share of common word shingles, for a filter: the SimHash trie join, widened, and an exact check.

The SimHash of a document's shingles within 4 bits finds few pairs at a similarity of 0.8 (about 10 of its bits differ
in the mean), so a filter that is to catch them joins SPACES more 64-bit prints a document in the same tries, each made
of 64 one-bit minhashes of the shingles: at a similarity s a bit differs with probability (1 - s) / 2. Candidates are
the pairs within the budget in some space; they are checked exactly, on the shingle sets of the whole texts.

The tries give stars, which span the candidates of a trie. The first round checks the stars' links. Those that fail may
have stood for candidates that hold, so each further round checks candidates inside the stars that still have several
groups, each member against the nearest members of other groups, STEP times as many a round, until each candidate is
checked, or its ends are in one group, or its sets' sizes or samples keep it under the similarity. The stars of a space
that hang together are one star for this, so that a document comes once a space and not once a trie, unless that star had
over BLOCK members; and a star whose candidates have all come is left out of further rounds. A sample holds all
shingle hashes of a text of up to WHOLE, so that such texts are compared exactly, else the LOW least. The share that the
least LOW of two texts' hashes have in common is off by its deviation, and a pair goes if it lies SLACK deviations under
the similarity, which befalls one pair at the similarity in 30,000. A candidate is looked at in the
stars of the first space in which it is near, and in no other.

A star of more members than a task's fair share (PART at least, BLOCK at most) is dealt over tasks of about as many: parts
of the members that look for candidates, which are those outside its largest group, meet parts of all its members, each
two parts once.

Shingle sets are one-permutation hashed: a hash falls into one of 64 * SPACES bins, a bin keeps its least, an empty bin
borrows from the next filled one.

Defined cases: texts without a word are alike. Texts of fewer words than a shingle are one shingle. Null counts as
empty. Repeated rows and equal texts are one group. Rows of one id with different texts are documents of their own. An
empty table gives an empty result. Other columns are ignored, and kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fresh, partitions, save, spread_join, texts_bytes, tune
from gridloom.llm.components import components
from gridloom.llm.simhash import fingerprint, shingle_hashes, trie_links

WORDS = 5
SIMILARITY = 0.8
SPACES = 12
BUDGET = 4
#: Candidates a member of a star brings to the first round behind the stars' links, and the factor from round to round.
STEP = 8
#: Members up to which the stars of a space are put together, and up to which a star may be one task's; of a larger one a
#: task takes about as many of either side.
BLOCK = 4096
#: Members up to which a star is always one task's, however few a task's fair share is.
PART = 256
#: Bytes of texts and shingle sets that a check keeps for the next pairs.
_HELD = 16 << 20
#: Pairs of members that are compared at a time.
_FRONT = 1 << 18

#: Shingle hashes up to which a sample holds them all, the least ones that it holds beyond that, and the deviations by
#: which an estimate may fall short.
WHOLE, LOW = 256, 128
SLACK = 4.0

_SKETCH = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("node", pa.int64()), ("size", pa.int64()), ("prints", pa.list_(pa.int64())), ("low", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_MUL = np.uint64(0x9E3779B97F4A7C15)


def sketch(hashes: np.ndarray, spaces: int = SPACES) -> np.ndarray:
    """`spaces` signed 64-bit words of one-bit minhashes."""
    bins = 64 * spaces
    if not len(hashes):
        return np.zeros(spaces, np.int64)
    h = np.unique(hashes)
    bin_ = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bin_[1:] != bin_[:-1]]))  # h is sorted, so the first is a bin's least
    filled = bin_[first]
    source = np.searchsorted(filled, np.arange(bins)) % len(filled)
    away = (filled[source] - np.arange(bins)) % bins
    value = (h[first][source] + away.astype(np.uint64)) * _MUL
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return np.packbits((value >> np.uint64(63)).astype(np.uint8).reshape(spaces, 64), axis=1, bitorder="little").view(np.int64).ravel()


def least_hashes(hashes: np.ndarray) -> bytes:
    """All distinct hashes, mixed to 32 bits, in order, if they are WHOLE or fewer; else the LOW least."""
    x = (hashes * _MUL) >> np.uint64(32)
    if len(x) > 4 * WHOLE:
        x = np.partition(x, 2 * WHOLE)[: 2 * WHOLE]
    x = np.unique(x)
    return x[: LOW if len(x) > WHOLE else None].astype("<u4").tobytes()


def _samples(column: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples as rows of a matrix, filled up with numbers beyond all hashes, and whether each holds all of its text's."""
    out = np.full((len(column), WHOLE), 1 << 32, np.int64)
    for k, b in enumerate(column):
        out[k, : len(b) // 4] = np.frombuffer(b, "<u4")
    return out, size <= WHOLE


def could_be_alike(low: np.ndarray, whole: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the samples at a and b leave it open that the sets are alike by similarity."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 10):
        x, y = a[at : at + (1 << 10)], b[at : at + (1 << 10)]
        both = np.sort(np.concatenate([low[x], low[y]], 1), 1)
        twin = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < 1 << 32)
        real = both < 1 << 32
        real[:, 1:] &= ~twin  # distinct hashes of the union, in order
        place = np.cumsum(real, 1)
        # the union's LOW least are known whatever the samples, all of them if both are whole
        exact = whole[x] & whole[y]
        known = np.where(exact, place[:, -1], np.minimum(LOW, place[:, -1]))
        shared = (twin & (place[:, 1:] <= known[:, None])).sum(1)
        slack = np.where(exact, 0, SLACK * np.sqrt(similarity * (1 - similarity) / LOW))
        # two hashes in a few million meet in 32 bits: one place is allowed for it
        out[at : at + (1 << 10)] = shared + 1 >= (similarity - slack) * known
    return out


def _sketches(words: int, spaces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, tuple[str, int, int, list[int], bytes]] = {}
            out = []
            for text in texts_bytes(batch.column(1)):
                if text not in seen:
                    every = shingle_hashes(text, words)
                    h = np.unique(every)
                    seen[text] = (hashlib.sha256(text).hexdigest(), int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64)), len(h), [fingerprint(every), *sketch(h, spaces).tolist()], least_hashes(h))
                out.append(seen[text])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, _SKETCH.types[1:], strict=True))], schema=_SKETCH)

    return run


def _alike(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both) if len(x) or len(y) else 1.0


def jaccard(a: bytes, b: bytes, words: int = WORDS) -> float:
    return _alike(np.unique(shingle_hashes(a, words)), np.unique(shingle_hashes(b, words)))


def _check(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}
        held = 0

        def of(text: bytes) -> np.ndarray:
            nonlocal held
            if text not in sets:
                if held > _HELD:
                    sets.clear()
                    held = 0
                sets[text] = np.unique(shingle_hashes(text, words))
                held += len(text) + sets[text].nbytes
            return sets[text]

        for batch in batches:
            x, y = texts_bytes(batch.column("ta")), texts_bytes(batch.column("tb"))
            yield batch.select(["a", "b"]).cast(_PAIR).filter(pa.array([_alike(of(p), of(q)) >= similarity for p, q in zip(x, y, strict=True)], pa.bool_()))

    return run


def near_steps(prints: np.ndarray, size: np.ndarray, group: np.ndarray, samples: tuple[np.ndarray, np.ndarray], space: int, most: int, budget: int = BUDGET, similarity: float = SIMILARITY, asks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Candidates (as places) among members of several groups that are first near in `space`, the `most` nearest of each
    member outside the largest group, and if any were left out; those of some such members at a time, a pair once unless
    some were left out. With asks, those of the members that ask among the others."""
    _, index, n = np.unique(group, return_inverse=True, return_counts=True)
    few = np.flatnonzero(index != n.argmax() if asks is None else asks)
    least, greatest = size * similarity, size / similarity
    told = np.zeros(len(group), bool)  # members all of whose candidates have come
    step = max(1, _FRONT // len(group))
    for low in range(0, len(few), step):
        at = few[low : low + step]
        near = np.bitwise_count(prints[at, None, space] ^ prints[None, :, space]) <= budget
        near &= index[at, None] != index[None, :]
        if asks is not None:
            near &= ~asks[None, :]
        near &= (size[at, None] >= least[None, :] - 1e-9) & (size[at, None] <= greatest[None, :] + 1e-9)
        x, y = np.nonzero(near)
        x = at[x]
        for earlier in range(space):
            other = np.bitwise_count(prints[x, earlier] ^ prints[y, earlier]) > budget
            x, y = x[other], y[other]
        able = could_be_alike(*samples, x, y, similarity)
        x, y = x[able], y[able]
        away = np.zeros(len(x), np.int64)
        for word in range(prints.shape[1]):
            away += np.bitwise_count(prints[x, word] ^ prints[y, word])
        order = np.lexsort((y, away, x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(x)))
        keep = np.arange(len(x)) - np.repeat(first, count) < most
        new = keep & ~told[y]
        told[at] = True
        told[x[~keep]] = False
        new &= ~(told[y] & ((x > y) | ~told[x]))  # y's row in this step has the pair
        yield x[new], y[new], not keep.all()


def nearest(*args, **more) -> tuple[np.ndarray, np.ndarray, bool]:
    """All steps of near_steps."""
    a, b, cut = zip((np.zeros(0, np.int64), np.zeros(0, np.int64), False), *near_steps(*args, **more), strict=True)
    return np.concatenate(a), np.concatenate(b), any(cut)


def _nearest(most: int, budget: int, similarity: float):
    """Candidates of each star, about _FRONT at a time, as a star of n members can have n * n; a row of a null and the star's
    name says that some were left out."""

    def star(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        node, size, group = (table.column(c).to_numpy() for c in ("node", "size", "component"))
        prints = table.column("prints").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        space = int(table.column("space")[0].as_py())
        asks = None if table.column("asks")[0].as_py() is None else table.column("asks").to_numpy()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        more, many = False, 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], schema=_PAIR)

        for a, b, cut in near_steps(prints.view(np.uint64), size, group, _samples(table.column("low").to_pylist(), size), space, most, budget, similarity, asks):
            more |= cut
            many += len(a)
            if len(a):
                held.append((node[a], node[b]))
            if many >= _FRONT:
                yield out()
                held, many = [], 0
        if held:
            yield out()
        if more:
            name = table.column("star" if asks is None else "of")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([name], pa.int64())], schema=_PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = batch.column("star").to_numpy()
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for low, high in zip(cut[:-1], cut[1:], strict=True):
                if low < high:
                    if held and key[low] != last:
                        yield from star(held)
                        held = []
                    held.append(batch.slice(low, high - low))
                    last = key[low]
        if held:
            yield from star(held)

    return run


def _members(near: DataFrame, equal: DataFrame) -> DataFrame:
    """(star, space, node) from the tries' links (a, b, space, trie) and those of equal prints (a, b, space), a saved table:
    nodes that are candidates in a space share a star of it. A node has one star a space, unless that would have over BLOCK
    members: then those of its tries and of its print."""
    cell = lambda node: F.xxhash64("space", node)
    links = near.select("a", "b", "space").unionByName(equal.select("a", "b", "space"))
    groups = components(links.select(cell("a").alias("a"), cell("b").alias("b"))).withColumnRenamed("node", "cell")
    ends = links.select("space", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cell", cell("node"))
    wide = save(ends.join(groups, "cell", "left").select(F.xxhash64("space", F.coalesce("component", "cell")).alias("star"), "space", "node"), "wide")
    large = save(wide.groupBy("star").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("star"), "large")
    if large.isEmpty():
        return wide
    again = save(wide.join(large, "star", "left_semi").select("space", F.col("node").alias("a")), "again")
    near, equal = (x.join(again, ["space", "a"], "left_semi") for x in (near, equal))
    # a trie's star: its holders, and the nodes of equal prints
    holders = near.select(F.xxhash64("trie", "b").alias("star"), "space", F.explode(F.array("a", "b")).alias("node")).distinct()
    behind = holders.join(equal.select(F.col("b").alias("node"), F.col("a").alias("member"), "space"), ["space", "node"]).select("star", "space", F.col("member").alias("node"))
    prints = equal.select(F.xxhash64("space", "b").alias("star"), "space", F.explode(F.array("a", "b")).alias("node"))
    few = wide.join(large, "star", "left_anti").select("star", "space", "node")
    return save(few.unionByName(holders.unionByName(behind).unionByName(prints).distinct()), "members")


def _dealt(members: DataFrame, block: int | None = None) -> DataFrame:
    """Members (star, space, node, component, n, with n a star's members) as the tasks' rows: star names the task, of the
    star, asks is null where the task holds the whole star, else whether the row looks for candidates or is looked at."""
    block = block or BLOCK
    row = [F.col(c) for c in ("space", "node", "component")]
    whole = members.where(F.col("n") <= block).select("star", F.col("star").alias("of"), *row, F.lit(None).cast("boolean").alias("asks"))
    large = members.where(F.col("n") > block)
    groups = large.groupBy("star", "component").agg(F.count("*").alias("c"))
    sums = groups.groupBy("star").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.ceil((F.sum("c") - F.max("c")) / block).alias("askers"))
    large = spread_join(large, sums, "star").withColumn("others", F.ceil(F.col("n") / block))
    part = lambda side, of: F.pmod(F.xxhash64(F.lit(side), "node"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    asking = large.where("component <> largest").select("star", *row, part("asks", "askers").alias("i"), every("others").alias("j"), F.lit(True).alias("asks"))
    asked = large.select("star", *row, every("askers").alias("i"), part("asked", "others").alias("j"), F.lit(False).alias("asks"))
    return whole.unionByName(asking.unionByName(asked).select(F.xxhash64("star", "i", "j").alias("star"), F.col("star").alias("of"), *row, "asks"))


def near_copy_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, spaces: int = SPACES, budget: int = BUDGET) -> DataFrame:
    """(doc_id, digest, component_id) of every row; digest is the text's SHA-256. Candidates are linked if their shingle sets
    are alike by `similarity` or more; a pair at 0.8 is a candidate with a probability of about 0.95."""
    sketches, nodes = _grouped(docs, words, similarity, spaces, budget)
    first = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = spread_join(nodes, first, "component").select("node", "component_id")
    return spread_join(sketches.select("doc_id", "digest", "node"), named, "node").select("doc_id", "digest", "component_id")


def _grouped(docs: DataFrame, words: int, similarity: float, spaces: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, digest and node, a saved table; and each node's least doc_id, representative and component, another."""
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketches = save(texts.mapInArrow(_sketches(words, spaces), "doc_id long, digest string, node long, size long, prints array<long>, low binary"), "sketches")
    # a node's representative: the row of the least id, then of the least digest
    nodes = save(sketches.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct(_rank(F.col("doc_id")).alias("id"), "digest")).alias("first")), "nodes")
    once = save(sketches.groupBy("node").agg(F.first("size").alias("size"), F.first("prints").alias("prints"), F.first("low").alias("low")), "once")  # equal in all rows of a node
    prints = once.select("node", F.posexplode("prints").alias("space", "print"))
    holder = save(prints.groupBy("space", "print").agg(F.min("node").alias("holder"), F.count("*").alias("n")), "holders")
    equal = spread_join(prints, holder.drop("n"), ["space", "print"], counts=holder.select("space", "print", "n")).where("node <> holder").select(F.col("node").alias("a"), F.col("holder").alias("b"), "space")
    equal = save(equal, "equal")
    near = save(trie_links(holder.select(F.col("holder").alias("node"), "space", "print"), budget, stars=True), "near")
    pairs = equal.select("a", "b").unionByName(near.select("a", "b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = save(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "first.id", "first.digest")
    keyed = texts.select(_rank(F.col("doc_id")).alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    bodies = save(keyed.join(ends, ["id", "digest"]).groupBy("node").agg(F.min("text").alias("text")), "bodies")

    def alike(pairs: DataFrame) -> DataFrame:
        both = spread_join(pairs, bodies.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(bodies.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return both.mapInArrow(_check(words, similarity), "a long, b long")

    groups = components(alike(pairs))
    members = _members(near, equal)
    seen, most = pairs, STEP
    while True:
        now = members.join(groups, "node", "left").select("star", "space", "node", F.coalesce("component", "node").alias("component"))
        open_ = now.groupBy("star").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
        open_ = save(open_.where("x <> y").select("star", "n"), "open")
        members = save(spread_join(now, open_, "star", counts=open_), "members")
        share = (open_.agg(F.sum("n")).first()[0] or 0) // partitions(spark)
        dealt = _dealt(members, min(BLOCK, max(PART, share))).join(once, "node").repartition(partitions(spark), "star").sortWithinPartitions("star")
        found = save(dealt.select("star", "of", "space", "node", "component", "asks", "size", "prints", "low").mapInArrow(_nearest(most, budget, similarity), "a long, b long").distinct(), "found")
        cut = found.where("a IS NULL").select(F.col("b").alias("star"))
        new = save(found.where("a IS NOT NULL").join(seen, ["a", "b"], "left_anti"), "new")
        if not new.isEmpty():
            seen = seen.unionByName(new)
            groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(alike(new)))
        if cut.isEmpty():
            break
        # the candidates of the other stars have all been checked
        members, most = members.drop("component", "n").join(cut, "star", "left_semi"), most * STEP
    return sketches, save(nodes.join(groups, "node", "left").select("node", "least", "first", F.coalesce("component", "node").alias("component")), "nodes")


def _rank(id_: Column) -> Column:
    """Null ids come last."""
    return F.coalesce(id_.cast("long"), F.lit((1 << 63) - 1))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs, all columns, of each group: that of the least id, of the least text digest where ids are equal or
    all null. Of rows with this id and text any one stays."""
    _, nodes = _grouped(docs, words, similarity, SPACES, BUDGET)
    id_, digest = fresh(docs, "_id"), fresh(docs, "_digest")
    kept = nodes.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.id").alias(id_), F.col("first.digest").alias(digest))
    keyed = docs.withColumn(id_, _rank(F.col("doc_id"))).withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    return keyed.join(kept, [id_, digest], "left_semi").dropDuplicates([id_, digest]).select(*docs.columns)
