"""Quality classifier: logistic regression on hashed word n-grams, learnt with follow-the-regularised-leader updates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidelens.llm import text as T
from tidelens.llm.native import store

SALTS = tuple(np.uint64(s) for s in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B, 0xA54FF53A510E527F, 0xBB67AE8584CAA73B, 0x6A09E667F3BCC908))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, one for each hash bucket
    bias: float


def _ngrams(w: T.Words, n: int, salt: np.uint64, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = w.hashes
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    acc = h[:len(h) - n + 1] ^ salt
    for i in range(1, n):
        acc = T.mix64(acc) + h[i:len(h) - n + 1 + i]
    same = w.doc[:len(acc)] == w.doc[n - 1:]
    return (T.mix64(acc)[same] >> np.uint64(64 - bits)).astype(np.int64), w.doc[:len(acc)][same]


def features(raw: np.ndarray, off: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of each n-gram, kind by kind: words, their pairs, the patterns of equal words in triples; then shapes of words,
    their pairs and triples."""
    plain = T.all_words(raw, off)
    for n, salt in ((1, SALTS[0]), (2, SALTS[1])):
        yield _ngrams(plain, n, salt, bits)
    h, doc = plain.hashes, plain.doc
    if len(h) < 3:
        yield np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        same = doc[2:] == doc[:-2]
        pattern = (h[:-2] == h[1:-1]) * 1 + (h[1:-1] == h[2:]) * 2 + (h[:-2] == h[2:]) * 4
        yield (T.mix64(pattern.astype(np.uint64) ^ SALTS[5])[same] >> np.uint64(64 - bits)).astype(np.int64), doc[2:][same]
    shape = T.all_words(raw, off, fold=T.SHAPE, runs=True)
    for n, salt in ((1, SALTS[2]), (2, SALTS[3]), (3, SALTS[4])):
        yield _ngrams(shape, n, salt, bits)


def _train(batches: Iterator[pa.RecordBatch], bits: int, alpha: float, beta: float, l1: float, l2: float) -> Iterator[pa.RecordBatch]:
    """Per-coordinate FTRL-proximal steps over (text, target) in the order of the rows."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    always = 1 << bits

    def weight(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where((np.abs(z[i]) <= l1) & (i != always), 0.0, w)

    for batch in batches:
        for part in T.slices(batch, "text"):
            raw, off = T.buffers(part.column("text"))
            kinds = []
            for bucket, row in features(raw, off, bits):
                key, count = np.unique(row << bits | bucket, return_counts=True)
                row, bucket = key >> bits, key & (always - 1)
                per_row = np.bincount(row, weights=count, minlength=part.num_rows)
                kinds.append((bucket, count / per_row[row], np.searchsorted(row, np.arange(part.num_rows + 1))))
            for r, target in enumerate(part.column("target").to_pylist()):
                i = np.concatenate([b[c[r]:c[r + 1]] for b, _, c in kinds] + [np.array([always])])
                x = np.concatenate([v[c[r]:c[r + 1]] for _, v, c in kinds] + [np.ones(1)])
                i, where = np.unique(i, return_inverse=True)
                x = np.bincount(where, weights=x)
                w = weight(i)
                g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - target) * x
                step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
                z[i] += g - step * w
                n[i] += g * g
    w = weight(np.arange((1 << bits) + 1))
    used = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array([used.astype(np.int32).tobytes()], pa.binary()), pa.array([w[used].astype(np.float32).tobytes()], pa.binary())], ["bucket", "weight"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "quality", learn: Column | None = None,
        max_rows: int = 4_000, passes: int = 10, bits: int = 18, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> Model:
    """Learn from a bounded sample: the ``max_rows`` labelled documents with the smallest hash of their id.

    ``learn`` (a condition on ``labels``) limits what labels are used; null labels are not. Several labels of an id are averaged and
    rounded; rows of documents sharing an id all learn. A null text is empty; with no labelled document the model scores 0.5.
    The sample (at most ``max_rows`` ids, hence broadcast) streams through one task ``passes`` times, each time in a new order; the model
    has at most 2**bits + 1 weights.
    """
    rows = labels.filter(F.col(target_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        rows = rows.filter(learn)
    chosen = (rows.groupBy(F.col(id_col).alias("id")).agg(F.round(F.avg(target_col)).cast("double").alias("target"))
              .withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(max_rows))
    chosen = store(chosen)
    again = chosen.select("id", "target", F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass")).withColumn("h", F.xxhash64("id", "pass"))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(again), "id").repartition(1).sortWithinPartitions(
        "pass", "h", "id", "text").select("text", "target")
    got = sample.mapInArrow(lambda it: _train(it, bits, alpha, beta, l1, l2), "bucket binary, weight binary").collect()
    weights, bias = np.zeros(1 << bits, np.float32), 0.0
    for r in got:
        bucket, w = np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["weight"], np.float32)
        inner = bucket < 1 << bits
        weights[bucket[inner]] = w[inner]
        bias += float(w[~inner].sum())
    return Model(weights, bias)


def scorer(docs: DataFrame, model: Model):
    """A function of a text column: the probability of label 1. Whole texts; null or empty text has the bias alone."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(model), int(len(model.weights)).bit_length() - 1

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        m, out = shared.value, []
        table = pa.RecordBatch.from_arrays([column], ["text"])
        for part in T.slices(table, "text"):
            raw, off = T.buffers(part.column("text"))
            total = np.full(part.num_rows, m.bias)
            for bucket, row in features(raw, off, bits):
                count = np.bincount(row, minlength=part.num_rows)
                total += np.bincount(row, weights=m.weights[bucket], minlength=part.num_rows) / np.maximum(count, 1)
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and a double column ``out`` (in place of one of that name)."""
    return docs.withColumn(out, scorer(docs, model)(F.col(text_col)))
