"""Removal of passages that earlier documents hold already, by a hash-compared suffix sort.

A passage is a string of WINDOW bytes; a byte goes when some passage over it also starts in a document with a
smaller id. Windows are compared exactly, but only those that can have a twin are moved:

1. Equal texts meet once, by a grouped aggregation, and go on as one text with its smallest id, in packs of texts.
2. Each window picks the smallest k-gram hash inside it (its anchor), a choice that equal windows share. Packs send
   their anchor hashes as sorted, compressed blocks; a reducer answers with a bit for each hash that two packs, or
   two texts of a pack, hold.
3. Packs send the bytes around the anchors with such a bit, equal ones once under their least id. A reducer sorts the
   suffixes at the windows' places: they are dealt by their first HEAD bytes, then merge-sorted, where a comparison finds
   the common extension of two suffixes by binary search over polynomial prefix hashes. Equal windows come to lie side by
   side; the bytes of all neighbours are compared, which verifies the order against collisions.
4. Packs get back which windows a smaller document has, and cut their texts.

Texts stay in bucketed packs; what moves is about three bytes an anchor, and the surroundings of shared anchors. A
passage that very many documents hold sends one row a pack. An anchor of very many occurrences could gather too many
differing surroundings in one place. From LONGER_FROM occurrences on each of its windows holds MORE bytes before or
behind it as well, and is dealt by these and the anchor together; from ALONE_FROM on windows are dealt one by one, by
all their bytes, so that only equal ones meet, and a pack sends each once. Equal windows hold equal strings, so each way
finds the same.

Defined cases: null and empty texts have nothing to remove. A null id sorts after all others. Rows with the same id
count as one document for "smaller", so repeated rows never remove each other. Texts under WINDOW bytes stay whole.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import by_key, drop, partitions, rows, save, save_bucketed, spread_join, tune, utf8

WINDOW = 50
GRAM = 25
PACK_BYTES = 4 << 20
#: Occurrences of an anchor (each pack's count rounded up to a power of two) from which on its windows are dealt by a
#: string of MORE further bytes, and from which on they are dealt one by one.
LONGER_FROM, ALONE_FROM = 1 << 12, 1 << 16
MORE = 13
#: Suffixes are dealt by so many first bytes before they are merge-sorted.
HEAD = 8
_CHUNK = 1 << 20
#: Blocks that leave a worker at a time.
_OUT_ROWS, _OUT_BYTES = 1 << 12, 1 << 20
_BASE = 0xD6E8FEB86659FD93
_POS_BITS = 26
_MASK = np.uint64((1 << _POS_BITS) - 1)
_LAST_ID = (1 << 63) - 1

_PACK = pa.schema([("pack_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("tids", pa.list_(pa.string())), ("blob", pa.binary())])
_BLOCK = pa.schema([("part", pa.int32()), ("pack_id", pa.int64()), ("blob", pa.binary())])
_CUT = pa.schema([("tid", pa.string()), ("first_id", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pack_bytes: int = PACK_BYTES, longer_from: int = LONGER_FROM, alone_from: int = ALONE_FROM) -> DataFrame:
    """One row a document: its id, bytes, removed bytes and runs, and the SHA-256 of what is left."""
    spark = docs.sparkSession
    tune(spark)
    parts = 4 * partitions(spark)
    texts = docs.select(F.coalesce(F.col(id_col), F.lit(_LAST_ID)).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    once = texts.groupBy("text").agg(F.min("id").alias("id")).select("id", F.sha2("text", 256).alias("tid"), "text")
    packs = save_bucketed(once.mapInArrow(_pack(pack_bytes), _ddl(_PACK)), "packs", "pack_id")

    offered = packs.select("pack_id", "ids", "ends", "blob").mapInArrow(_offer(parts), _ddl(_BLOCK))
    shared = offered.repartition(partitions(spark), "part").sortWithinPartitions("part").mapInArrow(_shared(longer_from, alone_from), _ddl(_BLOCK))
    candidates = packs.select("pack_id", "ids", "ends", "blob").join(_per_pack(shared), "pack_id").mapInArrow(_context(parts), _ddl(_BLOCK))
    judged = save(candidates.repartition(partitions(spark), "part").sortWithinPartitions("part").mapInArrow(_judge, _ddl(_BLOCK)), "judged")
    cut = save(packs.join(_per_pack(judged), "pack_id", "left").mapInArrow(_cut, _ddl(_CUT)), "cut")

    drop(packs)
    drop(judged)
    rest = save(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("tid")), "text_ids")
    copy = (F.coalesce("doc_id", F.lit(_LAST_ID)) > F.col("first_id")) & (F.col("n_bytes") >= WINDOW)
    return spread_join(rest, cut, "tid").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "bigint", "int32": "int", "string": "string", "binary": "binary", "list<item: int64>": "array<bigint>", "list<item: string>": "array<string>", "list<element: int64>": "array<bigint>"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def _per_pack(blocks: DataFrame) -> DataFrame:
    """A pack's answers in one row; a pack's size bounds them."""
    return blocks.groupBy("pack_id").agg(F.collect_list(F.struct("part", "blob")).alias("answers"))


def _batched(blocks: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Blocks (part, pack_id, blob) in batches of up to _OUT_ROWS, or of about _OUT_BYTES. Packs times parts is their number,
    which grows with the square of the input, so that a batch of its own for each would come to be most of the work."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for block in blocks:
        held.append(block)
        size += len(block[2])
        if size >= _OUT_BYTES or len(held) >= _OUT_ROWS:
            yield rows(_BLOCK, **dict(zip(_BLOCK.names, zip(*held, strict=True), strict=True)))
            held, size = [], 0
    if held:
        yield rows(_BLOCK, **dict(zip(_BLOCK.names, zip(*held, strict=True), strict=True)))


def _pack(pack_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=3)
        ids: list[int] = []
        tids: list[str] = []
        texts: list[bytes] = []
        size = 0

        def full() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts])
            return rows(_PACK, pack_id=[(task << 32) + count], ids=[ids], ends=[ends.tolist()], tids=[tids], blob=[squeeze.compress(b"".join(texts))])

        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, (doc, tid) in enumerate(zip(batch.column("id").to_pylist(), batch.column("tid").to_pylist(), strict=True)):
                ids.append(doc)
                tids.append(tid)
                texts.append(data[at[i] : at[i + 1]].tobytes())
                size += len(texts[-1])
                if size >= pack_bytes or len(ids) >= 50_000:
                    yield full()
                    ids, tids, texts, size, count = [], [], [], 0, count + 1
        if ids:
            yield full()

    return run


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """The mixed hash of each GRAM bytes, by doubling the length of polynomial hashes."""
    def times(n: int) -> np.uint64:
        return np.uint64(pow(_BASE, n, 1 << 64))

    have, n = data.astype(np.uint64) + np.uint64(1), 1
    first, done = None, 0
    left = GRAM
    while left:
        if left & 1:
            if first is None:
                first, done = have, n
            else:
                span = len(data) - done - n + 1
                first = first[:span] * times(n) + have[done : done + span]
                done += n
        left >>= 1
        if left:
            have = have[:-n] * times(n) + have[n:]
            n *= 2
    first ^= first >> np.uint64(29)
    first *= np.uint64(0xBF58476D1CE4E5B9)
    first ^= first >> np.uint64(32)
    return first


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: its hash, the first window's start, the number of windows and its place."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= WINDOW
    starts, lasts = starts[long], ends[long] - WINDOW  # the first and last window of each text
    width = WINDOW - GRAM + 1
    for low in range(0, len(data), _CHUNK):
        piece = data[low : low + _CHUNK + WINDOW - 1]
        if len(piece) < WINDOW:
            break
        gram = _gram_hashes(piece)
        least, n = (gram & ~_MASK) | np.arange(len(gram), dtype=np.uint64), 1
        while 2 * n <= width:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < width:
            least = np.minimum(least[: n - width], least[width - n :])
        a, b = np.searchsorted(lasts, low), np.searchsorted(starts, low + len(least))
        edge = np.zeros(len(least) + 1, np.int8)
        np.add.at(edge, np.maximum(starts[a:b] - low, 0), 1)
        np.add.at(edge, np.minimum(lasts[a:b] - low + 1, len(least)), -1)
        inside = np.cumsum(edge[:-1]) > 0
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1])
        fresh = starts[a:b] - low
        new[fresh[fresh >= 0]] = True
        at = np.flatnonzero(new | ~inside)
        size = np.diff(np.append(at, len(least)))
        keep = inside[at]
        at, size = at[keep], size[keep]
        spot = (least[at] & _MASK).astype(np.int64)
        found.append((gram[spot], at + low, size, spot + low))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"]), np.uint8), np.asarray(row["ends"], np.int64)


def _dealt(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _distinct(hashes: np.ndarray, doc: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pack's distinct anchors in order of part and hash: keys of part and 32 bits, a mark, and each anchor's place.

    The mark is the occurrences' logarithm, rounded up, and in its highest bit whether two texts have the anchor.
    """
    key = (_dealt(hashes, parts).astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
    order = np.argsort(key, kind="stable")
    key, text = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    twice = np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first) if len(first) else np.zeros(0, bool)
    many = np.ceil(np.log2(np.diff(np.append(first, len(key))))).astype(np.uint8)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return key[first], many | twice.astype(np.uint8) << 7, place


def _offer(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in batch.to_pylist():
                data, ends = _opened(row)
                hashes, start, *_ = anchors(data, ends)
                key, mark, _ = _distinct(hashes, np.searchsorted(ends, start, side="right"), parts)
                if not len(key):
                    continue
                which, at = np.unique((key >> np.uint64(32)).astype(np.int32), return_index=True)
                blobs = []
                for a, b in zip(at, np.append(at[1:], len(key)), strict=True):
                    low = (key[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    step = np.diff(low, prepend=np.uint32(0)).astype(np.uint32)
                    # bytes of equal weight side by side: the high ones are nearly constant
                    blobs.append(squeeze.compress(np.uint32(b - a).tobytes() + step.view(np.uint8).reshape(-1, 4).T.tobytes() + mark[a:b].tobytes()))
                yield rows(_BLOCK, part=which, pack_id=[row["pack_id"]] * len(which), blob=blobs)

    return run


def _shared(longer_from: int, alone_from: int):
    """For each pack's anchors three bits: whether another text has it, and whether its occurrences reach either bound."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(x for part, held in by_key(batches, "part") for x in _answers(part, held, longer_from, alone_from))

    return run


def _answers(part: int, held: list[dict], longer_from: int, alone_from: int) -> Iterator[tuple[int, int, bytes]]:
    open_ = zstandard.ZstdDecompressor()
    lows, marks, sizes = [], [], []
    for row in held:
        raw = open_.decompress(row["blob"])
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        lows.append(np.cumsum(np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n).T.copy().view(np.uint32).ravel(), dtype=np.uint32))
        marks.append(np.frombuffer(raw, np.uint8, offset=4 + 4 * n))
        sizes.append(n)
    low, mark = np.concatenate(lows), np.concatenate(marks)
    order = np.argsort(low, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], low[order][1:] != low[order][:-1]]))
    packs = np.diff(np.append(first, len(low)))
    again, total = np.empty(len(low), bool), np.empty(len(low), np.int64)
    again[order] = np.repeat(packs > 1, packs)
    again |= mark >> 7 > 0
    total[order] = np.repeat(np.add.reduceat(np.int64(1) << (mark[order] & 127).astype(np.int64), first), packs)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k, row in enumerate(held):
        mine = slice(at[k], at[k + 1])
        if again[mine].any():
            bits = (again[mine], total[mine] >= longer_from, total[mine] >= alone_from)
            yield part, row["pack_id"], b"".join(np.packbits(b).tobytes() for b in bits)


def _context(parts: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in batch.to_pylist():
                data, ends = _opened(row)
                hashes, start, size, spot = anchors(data, ends)
                doc = np.searchsorted(ends, start, side="right")
                key, _, place = _distinct(hashes, doc, parts)
                group = (key >> np.uint64(32)).astype(np.int32)
                wanted, longer, lone = (np.zeros(len(key), bool) for _ in range(3))
                for answer in row["answers"]:
                    a, b = np.searchsorted(group, [answer["part"], answer["part"] + 1])
                    bits = np.frombuffer(answer["blob"], np.uint8).reshape(3, -1)
                    wanted[a:b], longer[a:b], lone[a:b] = (np.unpackbits(x, count=b - a).astype(bool) for x in bits)
                pick = np.flatnonzero(wanted[place])
                if not len(pick):
                    continue
                raw = data.tobytes()
                each, many = pick[lone[place[pick]]], pick[(longer & ~lone)[place[pick]]]
                pick = pick[~(longer | lone)[place[pick]]]
                alone = np.repeat(start[each], size[each]) + _counted(size[each])
                whole = [xxhash.xxh3_64_intdigest(raw[p : p + WINDOW]) % parts for p in alone.tolist()]
                # a run in two: windows that hold MORE bytes before the anchor, and those that hold them behind it
                cut = np.clip(spot[many] - MORE + 1 - start[many], 0, size[many])
                left = [xxhash.xxh3_64_intdigest(raw[max(0, p - MORE) : p + GRAM]) % parts for p in spot[many].tolist()]
                right = [xxhash.xxh3_64_intdigest(raw[p : p + GRAM + MORE]) % parts for p in spot[many].tolist()]
                text = np.concatenate([doc[pick], doc[many], doc[many], np.repeat(doc[each], size[each])])
                begin = np.concatenate([start[pick], start[many], start[many] + cut, alone])
                length = np.concatenate([size[pick], cut, size[many] - cut, np.ones(len(alone), np.int64)])
                part = np.concatenate([_dealt(hashes[pick], parts), np.array(left, np.int32), np.array(right, np.int32), np.array(whole, np.int32)])
                some = length > 0
                text, begin, length, part = text[some], begin[some], length[some], part[some]
                # equal surroundings of a pack go once, under the least id that has them
                code_of: dict[bytes, int] = {}
                code = np.array([code_of.setdefault(raw[a:b], len(code_of)) for a, b in zip(begin.tolist(), (begin + length + WINDOW - 1).tolist(), strict=True)], np.int64)
                around = list(code_of)
                code_of.clear()
                home = np.empty(len(around), np.int32)
                home[code] = part  # equal surroundings have one part
                order = np.argsort(home, kind="stable")
                home, around = home[order], [around[i] for i in order.tolist()]
                place_of = np.empty(len(order), np.int64)
                place_of[order] = np.arange(len(order))
                code = place_of[code]
                ids = np.asarray(row["ids"], np.int64)[text]
                least = np.full(len(around), _LAST_ID)
                np.minimum.at(least, code, ids)
                n = np.array([len(c) - WINDOW + 1 for c in around], np.uint8)
                which, at = np.unique(home, return_index=True)
                for p, a, b in zip(which, at, np.append(at[1:], len(around)), strict=True):
                    blob = np.uint32(b - a).tobytes() + least[a:b].tobytes() + n[a:b].tobytes() + b"".join(around[a:b])
                    yield int(p), row["pack_id"], squeeze.compress(blob)
                # the pack's own notes ride along to the answers, under a part of their own
                notes = np.array([len(code), len(around), len(which)], np.uint32).tobytes() + least.tobytes() + ids.tobytes() + begin.astype(np.uint32).tobytes() + code.astype(np.uint32).tobytes() + which.astype(np.int32).tobytes() + np.diff(np.append(at, len(around))).astype(np.uint32).tobytes() + n.tobytes()
                yield -1 - ((row["pack_id"] >> 32) * 2654435761 + (row["pack_id"] & 0xFFFFFFFF) * 40503) % (1 << 30), row["pack_id"], squeeze.compress(notes)

    return lambda batches: _batched(blocks(batches))


class PrefixHashes:
    """Polynomial prefix hashes modulo 2**64 of one byte string, and comparisons of its suffixes by them."""

    def __init__(self, data: np.ndarray, reach: int = WINDOW) -> None:
        n = len(data)
        step = np.full(n + 1, np.uint64(_BASE))
        step[0] = 1
        power = np.multiply.accumulate(step)
        step[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
        self.unpower = np.multiply.accumulate(step)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])
        self.data, self.reach = data, reach
        self.searched = 0  # comparisons that took a binary search

    def of(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.unpower[at]

    def common(self, a: np.ndarray, b: np.ndarray, known: int = 0) -> np.ndarray:
        """The length of the common extension of suffixes a and b, up to reach, by binary search; they agree on `known` bytes."""
        least = np.full(len(a), self.reach)
        open_ = np.flatnonzero(self.of(a, self.reach) != self.of(b, self.reach))
        self.searched += len(open_)
        x, y = a[open_], b[open_]
        low, high = np.full(len(x), known), np.full(len(x), self.reach - 1)
        while len(x) and (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(x, mid) == self.of(y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        least[open_] = low
        return least

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray, known: int = 0) -> np.ndarray:
        """Whether suffix a sorts before b; where they agree as far as reach, ties says."""
        n = self.common(a, b, known)
        end = n >= self.reach
        n = np.minimum(n, self.reach - 1)
        return np.where(end, ties, self.data[a + n] < self.data[b + n])


def merge_sort(hashes: PrefixHashes, at: np.ndarray, segment: np.ndarray, known: int = 0) -> np.ndarray:
    """Order of the suffixes at `at` inside each run of equal segment: a bottom-up merge sort, all merges of a level at once.

    An element's place after a merge is its place in its own run plus its rank in the run beside it, which a binary
    search of suffix comparisons finds. The suffixes of a segment agree on their first `known` bytes.
    """
    n = len(at)
    new = np.ones(n, bool)
    new[1:] = segment[1:] != segment[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    begin, length = np.repeat(first, size), np.repeat(size, size)
    order, width = np.arange(n), 1
    while n and width < size.max():
        spot = np.flatnonzero(length > width)
        inner = spot - begin[spot]
        run = inner // width
        beside = (run ^ 1) * width
        low = np.minimum(beside, length[spot])
        high = np.minimum(beside + width, length[spot])
        base = low.copy()
        left = (run & 1) == 0
        suffix = at[order[spot]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            other = at[order[begin[spot[open_]] + mid]]
            under = hashes.before(other, suffix[open_], ~left[open_], known)  # equal ones of the left run stay first
            low[open_] = np.where(under, mid + 1, low[open_])
            high[open_] = np.where(under, high[open_], mid)
        place = begin[spot] + (run & ~1) * width + (inner - run * width) + (low - base)
        moved = order.copy()
        moved[place] = order[spot]
        order = moved
        width *= 2
    return order


def _words(data: np.ndarray) -> np.ndarray:
    """The HEAD bytes from each place on as a number that sorts like them; past the end they are zeros."""
    out = np.zeros(len(data), np.uint64)
    out[:] = data
    for n in (1, 2, 4):
        follow = np.zeros_like(out)
        follow[:-n] = out[n:]
        out = (out << np.uint64(8 * n)) | follow
    return out


def _compared(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the WINDOW bytes from a on sort before, like or after those from b on."""
    out = np.zeros(len(a), np.int8)
    for at in (*range(0, WINDOW - HEAD, HEAD), WINDOW - HEAD):
        open_ = np.flatnonzero(out == 0)
        x, y = words[a[open_] + at], words[b[open_] + at]
        out[open_] = (x > y).astype(np.int8) - (x < y).astype(np.int8)
    return out


def least_docs(data: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For the window at each place, the least doc of the places with an equal window.

    Suffixes are dealt by their first HEAD bytes and merge-sorted within, so that equal windows are neighbours. A
    comparison of all neighbours' bytes verifies the order and tells the equal ones: if a collision of hashes has led the
    sort astray, a segment is out of order somewhere, or has lost a place, and is sorted anew by its bytes.
    """
    words = _words(data)
    head = words[at]
    order = np.argsort(head, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = head[order][1:] != head[order][:-1]
    segment = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    out = doc.copy()
    if not len(first):
        return out
    docs = doc[order]
    twice = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
    keep = twice[segment]
    order, segment = order[keep], segment[keep]
    if not len(order):
        return out
    moved = merge_sort(PrefixHashes(data), at[order], segment, HEAD)
    lost = np.ones(len(order), bool)
    lost[moved] = False
    places = at[order[moved]]
    beside = np.flatnonzero(segment[1:] == segment[:-1]) + 1
    side = _compared(words, places[beside - 1], places[beside])
    equal = np.zeros(len(order), bool)
    equal[beside] = side == 0
    bad = np.union1d(segment[lost], segment[beside[side > 0]])
    spot = np.flatnonzero(np.isin(segment, bad)) if len(bad) else bad
    if len(spot):
        at_spot = at[order[spot]]
        raw = np.stack([data[at_spot + i] for i in range(WINDOW)], 1)
        whole = np.concatenate([segment[spot].astype(">u8").view(np.uint8).reshape(-1, 8), raw], 1)
        move = np.lexsort(whole.T[::-1])
        moved[spot], whole = spot[move], whole[move]
        equal[spot] = np.concatenate([[False], (whole[1:] == whole[:-1]).all(1)])
    order = order[moved]
    first = np.flatnonzero(~equal)
    out[order] = np.minimum.reduceat(doc[order], first)[np.cumsum(~equal) - 1]
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched(_judged(batches))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """For each pack's surroundings, a bit a window: whether a doc under the pack's least has it. Notes pass through."""
    open_ = zstandard.ZstdDecompressor()
    for part, held in by_key(batches, "part"):
        if part < 0:
            for row in held:
                yield part, row["pack_id"], row["blob"]
            continue
        code_of: dict[bytes, int] = {}
        codes, ids = [], []
        for row in held:
            raw = open_.decompress(row["blob"])
            n = int(np.frombuffer(raw, np.uint32, 1)[0])
            ids.append(np.frombuffer(raw, np.int64, n, 4))
            size = np.frombuffer(raw, np.uint8, n, 4 + 8 * n).astype(np.int64)
            end = 4 + 9 * n + np.cumsum(size + WINDOW - 1)
            begin = end - (size + WINDOW - 1)
            codes.append(np.array([code_of.setdefault(raw[a:b], len(code_of)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.int64))
            row["blob"] = None
        first_doc = np.full(len(code_of), _LAST_ID)
        for code, doc in zip(codes, ids, strict=True):
            np.minimum.at(first_doc, code, doc)
        length = np.fromiter(map(len, code_of), np.int64, len(code_of))
        size = length - (WINDOW - 1)
        data = np.frombuffer(b"".join(code_of), np.uint8)
        code_of.clear()
        base, offset = np.cumsum(length) - length, np.cumsum(size) - size
        at = np.repeat(base - offset, size) + np.arange(size.sum())
        least = least_docs(data, at, np.repeat(first_doc, size))
        for row, code, doc in zip(held, codes, ids, strict=True):
            n = size[code]
            under = np.repeat(doc, n) > least[np.repeat(offset[code], n) + _counted(n)]
            if under.any():
                yield part, row["pack_id"], np.packbits(under).tobytes()


def _counted(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _gone(answers: list[dict], length: int) -> np.ndarray:
    """Which bytes of a pack go: those of windows that a smaller doc of another pack, or of this one, has."""
    edge = np.zeros(length + 1, np.int32)
    replies = {a["part"]: a["blob"] for a in answers if a["part"] >= 0}
    for notes in (a["blob"] for a in answers if a["part"] < 0):
        raw = zstandard.ZstdDecompressor().decompress(notes)
        n, m, k = (int(x) for x in np.frombuffer(raw, np.uint32, 3))
        fields, at = [], 12
        for kind, many in ((np.int64, m), (np.int64, n), (np.uint32, n), (np.uint32, n), (np.int32, k), (np.uint32, k), (np.uint8, m)):
            fields.append(np.frombuffer(raw, kind, many, at))
            at += fields[-1].nbytes
        least, ids, start, code, part, many, size = fields
        size, code = size.astype(np.int64), code.astype(np.int64)
        begin = np.cumsum(size) - size
        under = np.zeros(size.sum(), bool)
        low = 0
        for p, c in zip(part.tolist(), many.tolist(), strict=True):
            if p in replies:
                a, total = int(begin[low]), int(size[low : low + c].sum())
                under[a : a + total] = np.unpackbits(np.frombuffer(replies[p], np.uint8), count=total).astype(bool)
            low += c
        # runs of such windows a surrounding, each once, then a record's runs
        before, after = np.append(False, under[:-1]), np.append(under[1:], False)
        before[begin] = False
        after[begin + size - 1] = False
        first, last = np.flatnonzero(under & ~before), np.flatnonzero(under & ~after)
        owner = np.searchsorted(begin, first, side="right") - 1
        runs = np.bincount(owner, minlength=m)
        at_run = np.cumsum(runs) - runs
        start, whole = start.astype(np.int64), ids > least[code]
        np.add.at(edge, start[whole], 1)
        np.add.at(edge, start[whole] + size[code[whole]] - 1 + WINDOW, -1)
        start, code = start[~whole], code[~whole]
        many = runs[code]
        pick = np.repeat(at_run[code], many) + _counted(many)
        base = np.repeat(start - begin[code], many)
        np.add.at(edge, base + first[pick], 1)
        np.add.at(edge, base + last[pick] + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            data, ends = _opened(row)
            gone = _gone(row["answers"] or [], len(data))
            begin = 0
            removed, spans, kept = [], [], []
            for end in ends.tolist():
                mine = gone[begin:end]
                removed.append(int(mine.sum()))
                spans.append(int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()))
                kept.append(hashlib.sha256(data[begin:end][~mine].tobytes()).hexdigest())
                begin = end
            yield rows(_CUT, tid=row["tids"], first_id=row["ids"], n_removed=removed, n_spans=spans, kept_sha256=kept)
