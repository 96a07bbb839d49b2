"""Mixing to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

Documents fall into cells of source, language and topic. Tokens are those of a byte-level BPE file. A document's vector is
the mean of fixed random vectors of its tokens; topics are the clusters of these vectors, found by k-means over all
documents (ROUNDS_OF_TOPICS passes over vectors of 2 * WIDTH bytes; sums are whole numbers, so the clusters do not depend
on the layout). One pass measures the texts and writes what it found beside them; the rest reads that.

A grouped sum gives the tokens of each cell. Raking scales the cells in turn until the shares of each margin meet its
targets. A cell's weight is fitted over actual tokens; one factor, found by bisection, turns weights into probabilities,
at most 1, that keep `keep` of all tokens in expectation. A document stays if the uniform number from its id's keyed hash
is under its cell's probability.

Cells are as many as combinations of three attributes; up to CELLS of them are raked on the driver and broadcast. Beyond
that the same steps run as grouped sums and joins on DataFrames.

Targets are shares by value; a margin's values without a target share what is left in proportion to their tokens. By
default a margin's target is its token shares raised to a power under 1, which evens out large sources.

Defined cases: null attributes are a value of their own. Null and empty texts have 0 tokens and follow their cell; a
cell without tokens keeps its rows. Repeated rows of an id stay or go together within a cell. Rows without an id draw
their number by their text. Very long texts are measured whole. An empty table gives an empty result. Other columns pass
through unchanged, but those named like one of RESULT, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop, fresh, save, tune
from gridloom.llm.packing import byte_bpe

CELLS = 200_000
ROUNDS = 100
BISECTIONS = 60
TOLERANCE = 1e-6
KEEP = 0.6
POWER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
NONE = "\x00none"
#: Columns that mix adds.
RESULT = ("_source", "_lang", "_topic", "_tokens", "_weight", "_p", "_u", "_selected")

#: Topics are 2**TOPIC_BITS clusters; vectors have WIDTH components of 16 bits, their length is _LENGTH.
TOPIC_BITS = 3
WIDTH = 16
ROUNDS_OF_TOPICS = 6
_LENGTH = 10_000
_SUMS = pa.schema([("topic", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("squares", pa.list_(pa.int64()))])


@cache
def token_vectors(ids: int) -> np.ndarray:
    """A fixed vector of +1 and -1 for each token id, from its mixed number."""
    x = np.arange(1, ids + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (2 * np.unpackbits((x >> np.uint64(64 - WIDTH)).astype(f">u{WIDTH // 8}").view(np.uint8).reshape(ids, -1), axis=1).astype(np.float32) - 1)


def document_vector(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """The sum of the tokens' vectors, scaled to _LENGTH and rounded, as 16-bit numbers; zeros where there is no token."""
    total = np.zeros(WIDTH)
    for low in range(0, len(ids), 1 << 16):
        total += vectors[ids[low : low + (1 << 16)]].sum(0)
    length = np.sqrt((total * total).sum())
    return np.rint(total * (_LENGTH / length if length else 0)).astype("<i2").tobytes()


def _measure(path: str, text_at: int, schema: pa.Schema | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)
        vectors = token_vectors(encode.size)
        for batch in batches:
            seen: dict[str, tuple[int, bytes]] = {}
            tokens, about = [], []
            for text in batch.column(text_at).to_pylist():
                text = text or ""
                if text not in seen:
                    ids = encode(text)
                    seen[text] = (len(ids), document_vector(ids, vectors))
                tokens.append(seen[text][0])
                about.append(seen[text][1])
            names = [f"c{k}" for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64()), pa.array(about, pa.binary())], names=[*names, "tokens", "about"])

    return run


def measured(docs: DataFrame, tokenizer: str, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """docs with the tokens and the vector of each text, a saved table, and the names of these two columns."""
    tune(docs.sparkSession)
    tokens, about = fresh(docs, "_n_tokens"), fresh(docs, "_about")
    ddl = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)), F.lit(0).cast("long").alias("tokens"), F.lit(b"").alias("about")).schema
    out = docs.mapInArrow(_measure(tokenizer, docs.columns.index(text_col)), ddl).toDF(*docs.columns, tokens, about)
    return save(out, "measured"), tokens, about


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(-1, WIDTH).astype(np.int64)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first on a tie."""
    return ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1).astype(np.int32)


def _sums(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = np.zeros(len(centres), np.int64), np.zeros((len(centres), WIDTH), np.int64), np.zeros((len(centres), WIDTH), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            topic = _nearest(x, centres)
            n += np.bincount(topic, minlength=len(centres))
            np.add.at(sums, topic, x)
            np.add.at(squares, topic, x * x)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array(squares.tolist(), pa.list_(pa.int64()))], schema=_SUMS)

    return run


def topic_centres(vectors: DataFrame, bits: int = TOPIC_BITS, rounds: int = ROUNDS_OF_TOPICS) -> np.ndarray:
    """Centres of 2**bits clusters of all vectors, one binary column: k-means from the corners that the components of
    largest spread make around the mean. A pass sends a row a task and cluster."""

    def totals(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        add = [F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("sums", "squares") for k in range(WIDTH)]
        got = {r["topic"]: r for r in vectors.mapInArrow(_sums(centres), "topic int, n long, sums array<long>, squares array<long>").groupBy("topic").agg(F.sum("n").alias("n"), *add).collect()}
        pick = lambda c: np.array([[got[t][f"{c}{k}"] if t in got else 0 for k in range(WIDTH)] for t in range(len(centres))], float)
        return np.array([got[t]["n"] if t in got else 0 for t in range(len(centres))], float), pick("sums"), pick("squares")

    n, sums, squares = totals(np.zeros((1, WIDTH)))
    mean = sums[0] / max(n[0], 1)
    spread = np.sqrt(np.maximum(squares[0] / max(n[0], 1) - mean * mean, 0))
    widest = np.argsort(-spread, kind="stable")[:bits]
    centres = np.repeat(mean[None, :], 2**bits, 0)
    for t in range(2**bits):
        for b, k in enumerate(widest):
            centres[t, k] += spread[k] if t >> b & 1 else -spread[k]
    for _ in range(rounds):
        n, sums, _ = totals(centres)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if (moved == centres).all():
            break
        centres = moved
    return centres


def _assign(centres: np.ndarray):
    def topic(about: pa.Array) -> pa.Array:
        return pa.array(_nearest(_matrix(about), centres))

    return F.arrow_udf(topic, "int")


def targets_of(shares: dict[str, float], power: float, given: dict[str, float] | None) -> dict[str, float]:
    """Target shares by value, which sum to 1 over the values present."""
    total = sum(shares.values()) or 1.0
    shares = {v: s / total for v, s in shares.items()}
    if given:
        fixed = {v: given[v] for v in shares if v in given}
        rest = {v: s for v, s in shares.items() if v not in given}
        left = max(0.0, 1 - sum(fixed.values()))
        spread = sum(rest.values())
        out = fixed | {v: left * s / spread if spread else 0.0 for v, s in rest.items()}
    else:
        out = {v: s**power if s > 0 else 0.0 for v, s in shares.items()}
    total = sum(out.values()) or 1.0
    return {v: s / total for v, s in out.items()}


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Shares of the cells: each margin in turn is scaled to its targets, until all margins agree."""
    share = tokens / max(tokens.sum(), 1e-300)
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, weights=share, minlength=len(target))
            factor = np.divide(target, now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, float(np.abs(now - target)[now > 0].max(initial=0)))
            share = share * factor[code]
        share = share / max(share.sum(), 1e-300)
        if worst < tolerance:
            break
    return share


def calibrate(weight: np.ndarray, tokens: np.ndarray, keep: float) -> np.ndarray:
    """Probabilities min(1, c * weight) whose expected tokens are `keep` of all."""
    goal = keep * tokens.sum()
    low, high = 0.0, 1.0
    for _ in range(200):
        if (np.minimum(1, high * weight) * tokens).sum() >= goal or high > 1e18:
            break
        high *= 2
    for _ in range(BISECTIONS):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * weight) * tokens).sum() < goal else (low, mid)
    return np.minimum(1, high * weight)


MARGINS = ("source", "lang", "topic")


def _named(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NONE))


def cell_probabilities(rows: DataFrame, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None, cells: int = CELLS) -> tuple[DataFrame, bool]:
    """From (source, lang, topic, n_tokens): each cell's weight and probability; whether they are few enough to broadcast."""
    spark = rows.sparkSession
    table = save(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "cells")
    given = targets or {}
    if table.count() > cells:
        return _rake_frames(table, keep, given), False
    got = sorted((r.asDict() for r in table.collect()), key=lambda r: [r[m] for m in MARGINS])
    if not got:
        return spark.createDataFrame([], "source string, lang string, topic string, weight double, p double"), True
    tokens = np.array([r["tokens"] for r in got], float)
    codes, goals = [], []
    for m in MARGINS:
        values, code = np.unique([r[m] for r in got], return_inverse=True)
        sums = np.bincount(code, weights=tokens)
        goal = targets_of(dict(zip(values.tolist(), sums.tolist(), strict=True)), POWER[m], given.get(m))
        codes.append(code)
        goals.append(np.array([goal[v] for v in values.tolist()]))
    share = rake(tokens, codes, goals)
    weight = np.divide(share * tokens.sum(), tokens, out=np.ones_like(tokens), where=tokens > 0)
    p = np.where(tokens > 0, calibrate(weight, tokens, keep), 1.0)
    return spark.createDataFrame([(*(r[m] for m in MARGINS), float(w), float(q)) for r, w, q in zip(got, weight, p, strict=True)], "source string, lang string, topic string, weight double, p double"), True


def _rake_frames(table: DataFrame, keep: float, given: dict[str, dict[str, float]]) -> DataFrame:
    """The same raking where cells are too many for the driver: grouped sums and joins, each round in the shared folder."""
    spark = table.sparkSession
    total = float(table.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    goals = {}
    for m in MARGINS:
        sums = table.groupBy(m).agg((F.sum("tokens") / total).alias("s"))
        if given.get(m):
            fixed = spark.createDataFrame(list(given[m].items()), f"{m} string, fixed double")
            sums = sums.join(fixed, m, "left")
            a = sums.agg(F.sum("fixed").alias("f"), F.sum(F.when(F.col("fixed").isNull(), F.col("s"))).alias("r")).first()
            left, spread = max(0.0, 1 - (a["f"] or 0.0)), a["r"] or 1.0
            sums = sums.withColumn("t", F.coalesce("fixed", F.col("s") * left / spread))
        else:
            sums = sums.withColumn("t", F.when(F.col("s") > 0, F.pow("s", F.lit(POWER[m]))).otherwise(0.0))
        whole = float(sums.agg(F.sum("t")).first()[0] or 1.0)
        goals[m] = save(sums.select(m, (F.col("t") / whole).alias("target")), "goal")
    now = save(table.withColumn("share", F.col("tokens") / total), "share")
    for _ in range(ROUNDS):
        nxt, worst = now, 0.0
        for m in MARGINS:
            sums = nxt.groupBy(m).agg(F.sum("share").alias("have")).join(goals[m], m)
            worst = max(worst, float(sums.where("have > 0").agg(F.max(F.abs(F.col("have") - F.col("target")))).first()[0] or 0.0))
            factor = sums.select(m, F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(1.0).alias("factor"))
            old, nxt = nxt, save(nxt.join(factor, m).withColumn("share", F.col("share") * F.col("factor")).drop("factor"), "share")
            drop(old)
        now = nxt
        if worst < TOLERANCE:
            break
    weighed = now.withColumn("weight", F.when(F.col("tokens") > 0, F.col("share") * total / F.col("tokens")).otherwise(1.0))
    low, high, goal = 0.0, 1.0, keep * total
    kept = lambda c: float(weighed.agg(F.sum(F.least(F.lit(1.0), F.col("weight") * c) * F.col("tokens"))).first()[0] or 0.0)
    while kept(high) < goal and high < 1e18:
        high *= 2
    for _ in range(BISECTIONS):
        mid = (low + high) / 2
        low, high = (mid, high) if kept(mid) < goal else (low, mid)
    return weighed.select(*MARGINS, "weight", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * high)).otherwise(1.0).alias("p"))


def uniform(id_: Column, text: Column, seed: int) -> Column:
    """A number from 0 up to 1 from the id's keyed hash; from the text's where there is no id."""
    h = F.coalesce(F.when(id_.isNotNull(), F.xxhash64(F.lit(seed), id_)), F.xxhash64(F.lit(seed), F.coalesce(text, F.lit("")), F.lit("text")))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def mix(docs: DataFrame, tokenizer: str, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None, seed: int = 11, topic: Column | None = None, cells: int = CELLS) -> DataFrame:
    """docs with the columns of RESULT; columns doc_id, text, lang and source are read. tokenizer: a byte-level BPE file.
    topic: an expression over docs in place of the clusters."""
    given = topic
    if given is not None:
        name = fresh(docs, "_given")
        docs = docs.withColumn(name, given.cast("string"))
    docs = docs.drop(*(c for c in docs.columns if c.lower() in RESULT))
    table, tokens, about = measured(docs, tokenizer)
    label = F.col(name) if given is not None else F.concat(F.lit("t"), _assign(topic_centres(table.select(about)))(F.col(about)).cast("string"))
    marked = table.select("*", _named(F.col("source")).alias("_source"), _named(F.col("lang")).alias("_lang"), _named(label).alias("_topic"), F.col(tokens).alias("_tokens"))
    marked = marked.drop(tokens, about, *([name] if given is not None else []))
    found, small = cell_probabilities(marked.select(*(F.col(f"_{m}").alias(m) for m in MARGINS), F.col("_tokens").alias("n_tokens")), keep, targets, cells)
    found = found.select(*(F.col(m).alias(f"_{m}") for m in MARGINS), F.col("weight").alias("_weight"), F.col("p").alias("_p"))
    out = marked.join(F.broadcast(found) if small else found, [f"_{m}" for m in MARGINS])
    return out.withColumn("_u", uniform(F.col("doc_id"), F.col("text"), seed)).withColumn("_selected", F.col("_u") < F.col("_p"))
