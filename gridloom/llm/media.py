"""Media columns: payloads stored as grey images, cut into content-defined chunks, each distinct chunk stored once.

A text's bytes, padded with blanks to a positive multiple of ROW, are the samples of a binary grey image (PGM, 8 bits,
ROW wide): the stored form. A rolling gear hash cuts the image into chunks; a chunk's digest is its name.

1. A scan gives each text its digest and its ordered chunk list (digests and lengths).
2. A grouped minimum makes one text the owner of each chunk; joins on the digest tell which chunks a text owns.
3. Each distinct text goes once to the store, with the bytes of the chunks that it owns and no others, dealt by text.
4. To read, the chunks that a text needs from others are joined in by digest; the list puts them in order, every chunk
   and the whole are verified, and the features are computed from the samples that were read back.

So a chunk's bytes are stored once, and move once to the store and again only where another text shares them. A chunk
that very many texts share, and a text that very many rows hold, are dealt over several tasks (see spread_join).

Defined cases: null and empty texts are one row of blanks. Equal texts have equal values and are stored once. A null
id keeps its row. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop, save, save_bucketed, spread_join, texts_bytes, tune

ROW = 192
LEAST, MOST = 1 << 10, 1 << 16
#: A cut where these bits of the gear hash are zero: chunks of 4 KiB beyond LEAST in the mean.
CUT_BITS = 12
_REACH = 32  # bytes that the 32-bit gear hash sees

_LISTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("tid", pa.binary()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32()))])
_OWN = pa.schema([("tid", pa.binary()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("names", pa.list_(pa.binary())), ("blobs", pa.list_(pa.binary()))])
_READ = pa.schema([("tid", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def payload(text: bytes) -> bytes:
    return text + b" " * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def encode(samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(samples) // ROW) + samples


def decode(media: bytes) -> bytes:
    """The samples of a binary grey image; an image of another shape or depth is an error."""
    magic, shape, depth, samples = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not a whole 8-bit grey image")
    return samples


def gear_table() -> np.ndarray:
    """256 mixed numbers, one a byte value."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = gear_table()


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks. The gear hash h = 2 h + gear[byte], kept to 32 bits, is built for all places by doubling."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h, span = _GEAR[np.frombuffer(data, np.uint8)], 1
    while span < _REACH:
        h = np.concatenate([h[:span], h[span:] + (h[:-span] << np.uint32(span))])
        span *= 2
    able = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    cuts, last, k = [], 0, 0
    while n - last > LEAST:
        while k < len(able) and able[k] - last < LEAST:
            k += 1
        nxt = min(able[k] if k < len(able) else n, last + MOST, n)
        cuts.append(nxt)
        last = nxt
    if last < n:
        cuts.append(n)
    return cuts


def chunks(media: bytes) -> tuple[list[bytes], list[bytes]]:
    """The chunks with their digests."""
    parts, a = [], 0
    for b in cut_points(media):
        parts.append(media[a:b])
        a = b
    return parts, [hashlib.blake2b(p, digest_size=16).digest() for p in parts]


def features(samples: bytes) -> str:
    """Mean, variance and entropy of the samples and the mean step along a row, from whole-number sums."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    n, level = len(x), np.arange(256)
    mean = int((count * level).sum()) / n
    var = int((count * level * level).sum()) / n - mean * mean
    p = count[count > 0] / n
    rows = x.reshape(-1, ROW).astype(np.int16)
    step = int(np.abs(np.diff(rows, axis=1)).sum()) / (rows.shape[0] * (ROW - 1))
    return f"mean={mean:.6f};var={var:.6f};entropy={-(p * np.log2(p)).sum():.6f};step={step:.6f};rows={rows.shape[0]}"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[bytes, tuple] = {}
        out = []
        for text in texts_bytes(batch.column(1)):
            if text not in seen:
                parts, digests = chunks(encode(payload(text)))
                seen[text] = (len(text), hashlib.sha256(text).digest(), digests, [len(p) for p in parts])
            out.append(seen[text])
        n, tid, digests, sizes = zip(*out, strict=True) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, f.type) for x, f in zip((n, tid, digests, sizes), list(_LISTED)[1:], strict=True))], schema=_LISTED)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct text of a batch as its digest and compressed bytes."""
    pack = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        once = {t: None for t in texts_bytes(batch.column(0))}
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t).digest() for t in once], pa.binary()), pa.array([pack.compress(t) for t in once], pa.binary())], names=["tid", "body"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in, the chunks they own out. A chunk without a twin has no entry in foreign."""
    open_ = zstandard.ZstdDecompressor()
    pack = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        for row in batch.to_pylist():
            parts, digests = chunks(encode(payload(open_.decompress(row["body"]) if row["body"] else b"")))
            foreign = set(row["foreign"] or ())
            mine = {d: p for d, p in zip(digests, parts, strict=True) if d not in foreign}
            # the owned chunks of a text are compressed together: one blob, cut by the sizes on reading
            blob = pack.compress(b"".join(mine.values()))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((row["tid"], digests, [len(p) for p in parts], list(mine), [blob]), _OWN, strict=True)], schema=_OWN)


def _opened(row: dict) -> dict[bytes, bytes]:
    """The owned chunks of a stored row by digest."""
    size = dict(zip(row["digests"], row["sizes"], strict=True))
    data = zstandard.ZstdDecompressor().decompress(row["blobs"][0]) if row["names"] else b""
    out, a = {}, 0
    for name in row["names"]:
        out[name] = data[a : a + size[name]]
        a += size[name]
    return out


def _lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of a stored row that other texts need."""
    pack = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        for row in batch.to_pylist():
            have = _opened(row)
            yield pa.RecordBatch.from_arrays([pa.array(row["lent"], pa.binary()), pa.array([pack.compress(have[d]) for d in row["lent"]], pa.binary())], names=["digest", "blob"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            have = _opened(row)
            for lent in row["lent"] or ():
                have[lent["digest"]] = open_.decompress(lent["blob"])
            parts = [have[d] for d in row["digests"]]
            for d, p in zip(row["digests"], parts, strict=True):
                if hashlib.blake2b(p, digest_size=16).digest() != d:
                    raise ValueError("a chunk does not match its digest")
            media = b"".join(parts)
            samples = decode(media)
            sha = hashlib.sha256(samples).hexdigest()
            out.append((row["tid"], len(samples), sha, zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(_READ), _READ, strict=True)], schema=_READ)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    tune(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    listed = save(texts.mapInArrow(_list, "doc_id long, n_bytes long, tid binary, digests array<binary>, sizes array<int>"), "chunk_lists")

    # who owns a chunk: the least text that has it; only chunks of several texts are of interest
    uses = save(listed.select("tid", F.explode(F.array_distinct("digests")).alias("digest")).distinct(), "chunk_uses")
    shared = save(uses.groupBy("digest").agg(F.min("tid").alias("owner"), F.count("*").alias("n")).where("n > 1"), "shared_chunks")
    borrowed = save(spread_join(uses, shared.drop("n"), "digest", counts=shared.select("digest", "n")).where("tid <> owner").select("tid", "digest", "owner"), "borrowed")
    foreign = borrowed.groupBy("tid").agg(F.collect_list("digest").alias("foreign"))

    bodies = texts.select("text").mapInArrow(_squeeze, "tid binary, body binary").groupBy("tid").agg(F.first("body").alias("body"))
    stored = bodies.join(foreign, "tid", "left").mapInArrow(_own, "tid binary, digests array<binary>, sizes array<int>, names array<binary>, blobs array<binary>")
    store = save_bucketed(stored, "chunk_store", "tid")

    lent = borrowed.select("owner", "digest").distinct().groupBy(F.col("owner").alias("tid")).agg(F.collect_list("digest").alias("lent"))
    loans = store.join(lent, "tid").mapInArrow(_lend, "digest binary, blob binary")
    needed = spread_join(borrowed.select("tid", "digest"), loans, "digest", counts=shared.select("digest", (F.col("n") - 1).alias("n"))).groupBy("tid").agg(F.collect_list(F.struct("digest", "blob")).alias("lent"))
    read = save(store.join(needed, "tid", "left").mapInArrow(_read, "tid binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"), "media_read")
    for table in (uses, shared, borrowed):
        drop(table)
    return spread_join(listed.select("doc_id", "n_bytes", "tid"), read, "tid").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
