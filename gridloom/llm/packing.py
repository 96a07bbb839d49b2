"""Packing of documents into fixed sequences by order-preserving dynamic programming.

Documents keep their stored order. Cuts between sequences may fall at a document's end (no penalty), at a sentence's
end (a small truncation penalty) and, inside a run of tokens with no such boundary, at every HARD_STEP tokens (a larger
one). The cost of a plan is its padding plus its penalties. With boundaries at token positions p, the least cost of a
plan that ends at boundary j is min over i with p[j] - p[i] <= size of cost[i] + size - (p[j] - p[i]) + penalty[j]:
the window of allowed i only slides, so a monotone queue over cost[i] + p[i] gives each transition in constant time.

Each task packs what it reads, in blocks of tokens; the tokens after a block's last cut open the next block, so a task
pads for a block's end only once. Nothing is shuffled. sequence_id is the task's number and a counter.

Defined cases: a null or empty text is its end token alone. Repeated rows are packed each. Very long texts are cut
like any other, and encoded in parts. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import tune

END_ID = 0
SENTENCE_PENALTY = 4
HARD_PENALTY = 32
HARD_STEP = 16
#: Tokens planned at a time.
BLOCK = 1 << 19
#: Characters that are encoded at a time.
LONG_TEXT = 100_000
_BREAK = re.compile(r"[^\s](?=[ \n])")

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteBpe:
    """The ids of a byte-level BPE file, by a fast merger of the same vocabulary; the file's own library where they could differ."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in _byte_chars().items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        self.special = tuple(special)
        self.exact = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
        ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        for token, i in ranks.items():
            ends[i] = token.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n") or b"\n" in token
        self.sentence_end = ends
        self.size = len(ends)

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):  # ids of special strings are the library's matter
            return self._exactly(text)
        if len(text) <= LONG_TEXT:
            return np.asarray(self.fast.encode_ordinary(text), np.uint32)
        # an unbroken run of more than LONG_TEXT characters is too long for the merger's pattern
        return np.concatenate([self._exactly(part) if len(part) > LONG_TEXT else np.asarray(self.fast.encode_ordinary(part), np.uint32) for part in apart(text)])

    def _exactly(self, text: str) -> np.ndarray:
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def apart(text: str) -> Iterator[str]:
    """A text in parts of LONG_TEXT characters or fewer where it can be cut behind a non-blank and before a blank.

    No token spans such a place, and none depends on what is left of it, so the parts' ids are the text's.
    """
    low = 0
    while len(text) - low > LONG_TEXT:
        cut = None
        for found in _BREAK.finditer(text, low + LONG_TEXT // 2, low + LONG_TEXT):
            cut = found.end()
            break
        if cut is None:
            found = _BREAK.search(text, low + LONG_TEXT // 2)
            cut = found.end() if found else len(text)
        yield text[low:cut]
        low = cut
    if low < len(text):
        yield text[low:]


def _byte_chars() -> dict[int, str]:
    """Byte-level BPE files spell printable bytes as themselves and the others as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def plan_cuts(position: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Indices of the chosen cuts over boundaries at position (from 0 on, neighbours at most size apart), the last one included."""
    at, fine = position.tolist(), penalty.tolist()
    n = len(at)
    cost, parent = [0.0] * n, [0] * n
    queue = deque([0])
    for j in range(1, n):
        least = at[j] - size
        while at[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        cost[j] = cost[i] + size - (at[j] - at[i]) + fine[j]
        parent[j] = i
        value = cost[j] + at[j]
        while queue and cost[queue[-1]] + at[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = parent[j]
    return cuts[::-1]


def boundaries(ends: np.ndarray, sentence: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may fall in `total` tokens, with their penalties; 0 is always one."""
    soft = np.union1d(np.concatenate([[0], ends]), sentence)
    if soft[-1] != total:
        soft = np.append(soft, total)
    gap = np.diff(soft)
    wide = np.flatnonzero(gap > 2 * HARD_STEP)
    hard = [np.arange(soft[w] + HARD_STEP, soft[w + 1], HARD_STEP) for w in wide]
    where = np.sort(np.concatenate([soft, *hard])) if hard else soft
    penalty = np.full(len(where), float(HARD_PENALTY))
    penalty[np.isin(where, sentence, assume_unique=False)] = SENTENCE_PENALTY
    penalty[np.isin(where, ends)] = 0.0
    penalty[0] = 0.0
    return where, penalty


def _pack(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)
        ends_at = encode.sentence_end
        sequence = TaskContext.get().partitionId() << 32
        docs: list[tuple[int, int, np.ndarray]] = []  # id, tokens before in earlier blocks, the rest of its ids
        tokens = 0

        def block(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal docs, tokens, sequence
            if not docs:
                return
            ids = np.concatenate([d[2] for d in docs])
            lengths = np.array([len(d[2]) for d in docs])
            ends = np.cumsum(lengths)
            known = ids < len(ends_at)
            mark = np.zeros(len(ids), bool)
            mark[known] = ends_at[ids[known]]
            where, penalty = boundaries(ends, np.flatnonzero(mark) + 1, len(ids))
            cuts = where[plan_cuts(where, penalty, size)]
            if not final and len(cuts) > 1:
                cuts = cuts[:-1]
            last = int(cuts[-1])
            # pieces: tokens between neighbouring ends of documents or sequences
            upto = ends[ends <= last]
            edges = np.union1d(np.concatenate([[0], upto]), cuts)
            a, b = edges[:-1], edges[1:]
            doc = np.searchsorted(ends, a, side="right")
            seq = np.searchsorted(cuts, a, side="right")
            begin = ends - lengths
            open_ = np.concatenate([[0], cuts[:-1]])
            raw = ids.astype("<u4").tobytes()
            before, total, name = (np.array(x, np.int64) for x in ([d[1] for d in docs], [d[1] + len(d[2]) for d in docs], range(len(docs))))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([docs[k][0] for k in doc.tolist()], pa.int64()),
                    pa.array(before[doc] + a - begin[doc]),
                    pa.array(b - a),
                    pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.int64()),
                    pa.array(total[doc]),
                    pa.array(sequence + seq),
                    pa.array(a - open_[seq]),
                ],
                schema=_PIECE,
            )
            sequence += len(cuts)
            k = int(np.searchsorted(ends, last, side="right"))
            rest = docs[k:]
            if rest:
                gone = last - int(begin[k])
                rest[0] = (rest[0][0], rest[0][1] + gone, rest[0][2][gone:])
            docs, tokens = rest, len(ids) - last

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id))
                docs.append((doc, 0, ids))
                tokens += len(ids)
                if tokens >= BLOCK:
                    yield from block(False)
        yield from block(True)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. tokenizer: a byte-level BPE file."""
    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pack(tokenizer, size, end_id), _DDL)
