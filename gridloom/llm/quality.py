"""Quality scores: random-indexing word vectors, pooled per document, into a two-layer network.

Fitting, on the driver, takes a bounded sample of labelled rows (SAMPLE rows and SAMPLE_BYTES of text at most, in the
order of the hash of their ids; a text that would pass the bound is left out as a whole):
- The sample's words that occur LEAST_COUNT times make the vocabulary, VOCABULARY of them at most, the most frequent
  first; other words go by their shape (case, digits, signs, runs collapsed), of which the model knows VOCABULARY at
  most, again the most frequent; words of no known entry share one. Each entry has a sparse random index vector from its hash; its word vector is the sum of the
  index vectors of its neighbours in the sample.
- A document is the mean and the spread of its words' vectors, the length of the mean, and how often a step stays put.
- A network with one hidden layer learns the label; a temperature that minimises the log loss on a part of the sample
  kept aside calibrates its probabilities.
Scoring covers every whole text, one pass without a shuffle; only the text enters it.

Defined cases: null and empty texts are documents of no word and get that document's score. Labels that are null or
lack a document are ignored; of several labels of an id the largest counts. Rows of an id are scored each. If no
labelled row may be learned from, every score is 0.5. An empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop, save, tune

#: Labelled rows that the fit may see at most.
SAMPLE = 6000
#: Bytes of text that the fit may see at most.
SAMPLE_BYTES = 48 << 20
LEAST_COUNT = 5
#: Words, and as many shapes, that the model holds at most: it bounds what is broadcast.
VOCABULARY = 50_000
#: Longer words are not remembered from text to text.
_KNOWN_LENGTH = 64
WIDTH = 48
NONZERO = 4
NEIGHBOURS = 2
HIDDEN = 32
THRESHOLD = 0.3
FOLDS = 5

_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_KINDS = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})


def shape(word: str) -> str:
    """aab12!! becomes a0!: letters by case, digits as 0, other signs as they are, runs as one."""
    out = []
    for c in word.translate(_KINDS):
        if ord(c) > 127:
            c = "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != c:
            out.append(c)
    return "\x00" + "".join(out)


def index_vector(entry: str) -> np.ndarray:
    """NONZERO entries of +1 or -1, placed by the entry's hash."""
    v = np.zeros(WIDTH, np.float32)
    for k in range(NONZERO):
        h = xxhash.xxh64_intdigest(entry.encode("utf-8", "surrogatepass"), seed=k)
        v[(h >> 1) % WIDTH] += 1.0 if h & 1 else -1.0
    return v


class WordVectors:
    """Entries (words and shapes) with their vectors; the last row stands for what is in neither."""

    def __init__(self, texts: list[str]) -> None:
        code: dict[str, int] = {}
        coded = [np.fromiter((code.setdefault(w, len(code)) for w in t.split()), np.int32) for t in texts]
        words, count = list(code), np.bincount(np.concatenate([*coded, np.zeros(0, np.int32)]), minlength=len(code))
        order = np.argsort(-count, kind="stable")
        kept = order[: int(np.searchsorted(-count[order], -LEAST_COUNT, side="right"))][:VOCABULARY]
        self.row = {words[i]: k for k, i in enumerate(kept.tolist())}
        shapes: Counter = Counter()
        for w, n in zip(words, count.tolist(), strict=True):
            if w not in self.row:
                shapes[shape(w)] += n
        for s, _ in shapes.most_common(VOCABULARY):
            self.row[s] = len(self.row)
        place = np.array([self._row_of(w) for w in words], np.int32)
        n = len(self.row)
        index = np.stack([index_vector(w) for w in self.row] + [np.zeros(WIDTH, np.float32)])
        total = np.zeros((n + 1, WIDTH), np.float64)
        for ws in coded:
            ids = place[ws]
            for k in range(1, NEIGHBOURS + 1):
                for a, b in ((ids[:-k], ids[k:]), (ids[k:], ids[:-k])):
                    if len(a):
                        pair, c = np.unique(a.astype(np.int64) * (n + 1) + b, return_counts=True)
                        to = pair // (n + 1)
                        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                        total[to[first]] += np.add.reduceat(index[pair % (n + 1)] * c[:, None], first)
        total[:n] += index[:n]
        length = np.sqrt((total**2).sum(1, keepdims=True))
        self.vectors = (total / np.where(length > 0, length, 1)).astype(np.float32)

    def _row_of(self, word: str) -> int:
        i = self.row.get(word)
        return self.row.get(shape(word), len(self.row)) if i is None else i

    def rows_of(self, words: list[str], known: dict[str, int]) -> np.ndarray:
        out = []
        for w in words:
            i = known.get(w)
            if i is None:
                i = self._row_of(w)
                if len(known) > 500_000:
                    known.clear()
                if len(w) <= _KNOWN_LENGTH:
                    known[w] = i
            out.append(i)
        return np.asarray(out, np.int32)

    def pooled(self, text: str, known: dict[str, int]) -> np.ndarray:
        """Mean, spread and length of the mean of a document's word vectors, and the share of steps on which the word stays."""
        words = text.split()
        ids = self.rows_of(words, known)
        if not len(ids):
            return np.zeros(2 * WIDTH + 2, np.float32)
        still = np.log(0.01 + sum(map(eq, words, islice(words, 1, None))) / len(words))
        rows, count = np.unique(ids, return_counts=True)
        v, p = self.vectors[rows], (count / len(ids)).astype(np.float32)
        mean = p @ v
        spread = np.sqrt(np.maximum(p @ (v * v) - mean * mean, 0))
        return np.concatenate([mean, spread, [np.sqrt((mean * mean).sum()), still]]).astype(np.float32)


@dataclass
class Network:
    """Standardised features, a hidden layer of rectifiers, a logistic output over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, aside: np.ndarray, epochs: int = 60, seed: int = 0) -> Network:
    """Adam on the log loss over the rows not kept aside; the temperature on those that are."""
    rng = np.random.default_rng(seed)
    train = np.flatnonzero(~aside)
    scale = x[train].std(0)
    net = Network(x[train].mean(0), np.where(scale > 1e-6, scale, 1).astype(np.float32), rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0)
    z = ((x - net.mean) / net.scale).astype(np.float64)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    moment, power, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for k in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            h = np.maximum(z[k] @ params[0] + params[1], 0)
            g = (1 / (1 + np.exp(-(h @ params[2] + params[3][0]))) - y[k]) / len(k)
            back = np.outer(g, params[2]) * (h > 0)
            grads = [z[k].T @ back + 1e-4 * params[0], back.sum(0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            step += 1
            for i, grad in enumerate(grads):
                moment[i] = 0.9 * moment[i] + 0.1 * grad
                power[i] = 0.999 * power[i] + 0.001 * grad**2
                params[i] -= 0.003 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(power[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if aside.any():
        # targets a little off 0 and 1: a part kept aside without an error gives no reason for certainty
        logit, off = net.logits(x[aside]), 1 / (aside.sum() + 2)
        target = np.where(y[aside] == 1, 1 - off, off)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 71))
        loss = [(target * np.logaddexp(0, -logit / t) + (1 - target) * np.logaddexp(0, logit / t)).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class QualityModel:
    words: WordVectors | None
    network: Network | None

    def score(self, texts: list[str | None], known: dict[str, int]) -> np.ndarray:
        if self.words is None or self.network is None:
            return np.full(len(texts), 0.5)
        if not texts:
            return np.zeros(0)
        return self.network.scores(np.stack([self.words.pooled(t or "", known) for t in texts]))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; 0 is held out."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learn from at most `sample` labelled rows, and `sample_bytes` of their texts, outside the held-out fold."""
    label = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(fold() != 0)
    chosen = label.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = save(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "labelled")
    sizes = sorted((r["k"], r["doc_id"], r["n"]) for r in found.select("doc_id", F.xxhash64("doc_id").alias("k"), F.octet_length("text").alias("n")).collect())
    within, total = set(), 0
    for _, i, n in sizes:
        if total + n <= sample_bytes:
            within.add(i)
            total += n
    if len(within) < len(sizes):
        names = found.sparkSession.createDataFrame([(i,) for i in sorted(within)], "doc_id long")
        got = found.join(F.broadcast(names), "doc_id").collect()
    else:
        got = found.collect()
    drop(found)
    got = sorted(got, key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in got], np.float64)
    if not len(got) or y.min() == y.max():
        return QualityModel(None, None)
    words = WordVectors([r["text"] for r in got])
    known: dict[str, int] = {}
    x = np.stack([words.pooled(r["text"], known) for r in got])
    aside = np.array([xxhash.xxh64_intdigest(str(r["doc_id"]).encode()) % 5 == 0 for r in got])
    if len(set(y[~aside])) < 2:
        aside[:] = False
    return QualityModel(words, fit_network(x, y, aside))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(model.value.score(batch.column(1).to_pylist(), known), pa.float64())], schema=_SCORED)

    return run


def _keep(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            yield batch.filter(pa.array(model.value.score(batch.column("text").to_pylist(), known) >= threshold))

    return run


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by VOCABULARY
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score at least threshold; the text is in the column text."""
    spark = docs.sparkSession
    tune(spark)
    return docs.mapInArrow(_keep(spark.sparkContext.broadcast(model), threshold), docs.schema)
