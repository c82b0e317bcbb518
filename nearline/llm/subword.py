"""Quality classifier on supervised subword embeddings.

Words and character n-grams are hashed into ``buckets`` learned vectors; a
document is the average of its vectors, and a softmax layer gives the class.
Vectors and layer are trained together by numpy stochastic gradient descent.
Because document and layer are linear, a trained model scores a text by
averaging one learned number per n-gram (its vector times the layer), which
is what :func:`score` does, over whole texts.

Training takes at most ``max_train_rows`` labelled rows, those with the
smallest hash of their id (a stated bound, the same at any corpus size).
Their features are counted in parallel, at most ``buckets`` numbers a row,
and one task runs the descent.  The model that comes back through the driver
has ``buckets`` numbers (256 KB by default), so it may be broadcast.

Defined cases: a null or empty text has no features and gets the score of
the bias alone; labels other than 0 and 1 and rows without text are not
trained on; without both classes the score is the share of label 1 (0.5 if
nothing is labelled); rows with repeated ids are scored one by one; an empty
table gives no rows; an id labelled twice counts once, with its smallest label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, text_bytes


@dataclass(frozen=True)
class SubwordParams:
    bits: int = 16                  # 2 ** bits vectors
    dim: int = 8
    ngrams: tuple[int, ...] = (2, 3, 4)
    epochs: int = 6
    rate: float = 0.5
    batch: int = 16
    seed: int = 7
    max_train_rows: int = 4000

    @property
    def buckets(self) -> int:
        return 1 << self.bits


_WORD = np.ones(256, bool)
_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_POWERS = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, 65, dtype=np.uint64)).astype(np.uint64)


def features(data: np.ndarray, offs: np.ndarray, p: SubwordParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(bucket, document number)`` arrays, one pair per kind of feature.

    Character n-grams are windows of n bytes inside one text; a word is a run
    of bytes other than the six separators.
    """
    n = len(data)
    if n == 0:
        return
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    left = offs[1:][doc] - np.arange(n)          # bytes from here to the text's end
    shift = np.uint64(64 - p.bits)
    x = data.astype(np.uint64)
    key = x
    for k in range(2, max(p.ngrams) + 1):
        key = (key[:-1] << np.uint64(8)) | x[k - 1:]
        if k in p.ngrams and len(key):
            ok = left[:len(key)] >= k
            yield ((key[ok] + np.uint64(k << 40)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int32), doc[:len(key)][ok]
    word = _WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1] | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    if len(at):
        span = np.cumsum(first) - 1
        place = (np.arange(n) - at[np.maximum(span, 0)]) & 63
        coded = np.where(word, (x + np.uint64(1)) * _POWERS[place], np.uint64(0))
        yield (mix64(np.add.reduceat(coded, at)) >> shift).astype(np.int32), doc[at]


def _chunks(data: np.ndarray, offs: np.ndarray, size: int = 1 << 20):
    """Whole texts in runs of about ``size`` bytes: ``(first, after, bytes, offsets)``."""
    a = 0
    while a < len(offs) - 1:
        z = max(a + 1, int(np.searchsorted(offs, offs[a] + size, side="right")) - 1)
        yield a, z, data[offs[a]:offs[z]], offs[a:z + 1] - offs[a]
        a = z


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, p: SubwordParams, keep) -> DataFrame:
    """``(doc_id, label, buckets, counts)`` of the bounded training sample.

    ``labels`` rows are chosen first (by hash of the id, then the id), so the
    join's small side has at most ``max_train_rows`` rows.  An id labelled
    twice counts once, with its smallest label.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
              .groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_train_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_bytes(b.column("text"))
            sets, counts = [], []
            for _, _, part, po in _chunks(data, offs, 1):      # text by text
                got = [f for f, _ in features(part, po, p)]
                u, c = np.unique(np.concatenate(got) if got else np.zeros(0, np.int32), return_counts=True)
                sets.append(u.astype(np.int32).tobytes())
                counts.append(c.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(sets, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["doc_id", "label", "buckets", "counts"])

    return rows.mapInArrow(run, "doc_id long, label int, buckets binary, counts binary")


def descend(rows: list[tuple[int, np.ndarray, np.ndarray]], p: SubwordParams) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent; ``(one number per bucket, bias)`` for the
    log odds of label 1."""
    ones = sum(r[0] for r in rows)
    if not rows or ones in (0, len(rows)):
        share = min(max(ones / len(rows), 1e-3), 1 - 1e-3) if rows else 0.5
        return np.zeros(p.buckets), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(p.seed)
    emb = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    layer = np.zeros((p.dim, 2), np.float32)
    layer[0] = (-0.5, 0.5)                                   # breaks the symmetry of a zero layer
    bias = np.zeros(2, np.float32)
    feats = [(y, u, (c / c.sum()).astype(np.float32)) if len(u) else (y, u, c) for y, u, c in rows]
    step, steps = 0, p.epochs * -(-len(feats) // p.batch)
    for _ in range(p.epochs):
        order = rng.permutation(len(feats))
        for s in range(0, len(order), p.batch):
            rate = p.rate * (1 - step / steps)
            step += 1
            part = [feats[i] for i in order[s:s + p.batch]]
            mean = np.stack([w @ emb[u] for _, u, w in part])
            z = mean @ layer + bias
            z = np.exp(z - z.max(1, keepdims=True))
            g = z / z.sum(1, keepdims=True)
            g[np.arange(len(part)), [y for y, _, _ in part]] -= 1
            back = g @ layer.T
            layer -= rate * (mean.T @ g) / len(part)
            bias -= rate * g.sum(0) / len(part)
            for (_, u, w), d in zip(part, back):
                emb[u] -= (rate * p.buckets ** 0.5 / 16) * w[:, None] * d
    return (emb @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, label_col: str, keep, p: SubwordParams = SubwordParams()) -> tuple[np.ndarray, float]:
    """Train on the bounded sample; returns one number per bucket and a bias."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for i, y, u, c in zip(*(b.column(k).to_pylist() for k in ("doc_id", "label", "buckets", "counts"))):
                rows.append((i, y, np.frombuffer(u, np.int32), np.frombuffer(c, np.float32)))
        rows.sort(key=lambda r: (r[0], len(r[2]), r[2].tobytes()))      # the same at any partitioning
        weights, bias = descend([r[1:] for r in rows], p)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])

    # An exchange, so that the scan and the features of all documents stay spread
    # and only the sample's rows (``max_train_rows`` labels at most) meet in one task.
    got = training_rows(docs, labels, label_col, p, keep).repartition(1).mapInArrow(run, "weights binary, bias double").collect()
    if not got:
        return descend([], p)
    return np.frombuffer(bytes(got[0]["weights"]), np.float64), got[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], p: SubwordParams = SubwordParams()) -> DataFrame:
    """``(doc_id, score)``: probability of label 1 of every whole text."""
    weights = docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32))
    bias = model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            data, offs = text_bytes(b.column("text"))
            total, count = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
            for a, z, part, po in _chunks(data, offs):
                for f, d in features(part, po, p):
                    total[a:z] += np.bincount(d, w[f], z - a)
                    count[a:z] += np.bincount(d, minlength=z - a)
            odds = total / np.maximum(count, 1) + bias
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
