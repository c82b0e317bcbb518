"""Language-model scoring by context-tree weighting.

A byte is eight binary decisions (the 255 inner nodes of a byte's tree, high
bit first), and each of these has a context tree over the bytes before it, of
depth 0 to ``depth`` (6).  Every context keeps counts of zeros and ones; its block
probability is Krichevsky and Trofimov's, and a context that is not of full
depth is weighted half by its own estimate, half by the product of its
children.  The weights that the training texts leave behind mix the estimates
of all depths when a text is scored: for each bit the deepest estimate, then
level by level (beta * own + deeper) / (beta + 1), beta being the ratio of a
context's own block probability to its children's product.  A text is coded
lower-cased (A-Z), after ``depth`` start bytes (0), and ended by a byte 0.

The model grows with the corpus and is never gathered.  Tasks count grams
(a byte with the bytes before it); shards, by a hash of the two nearest bytes
before, add them up and hold whole contexts of two bytes or more.  What lies
above those has 256 times 255 nodes, whatever the corpus, and is broadcast.
Texts are dealt into batches of bounded size; a batch asks the shards for the
log probabilities of its distinct grams and gets them back.

Beside it the words' smoothed unigram score is worked out the same way: tasks
count words as 64-bit hashes, shards (by hash range) sum them, and the same
batches ask for the counts of their words.

Defined cases: a null text is empty and is scored like one (only its end);
a null ``doc_id`` counts as training; rows with equal ids are scored one by one;
without training texts every bit has probability one half; an empty table
gives no rows; very long texts are scored whole.  Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bbit import _runs, word_hashes
from .common import mix64, pack, squeeze, text_bytes, text_size, unpack, unsqueeze
from .context_tree import NodeTable, Root, grams

DEPTH = 6
BATCH_BYTES = 8 << 20
SHARD_BYTES = 24 << 20
ALPHA = 0.1


# The byte model ------------------------------------------------------------

def gram_shard(key: np.ndarray, depth: int, shards: int) -> np.ndarray:
    """The shard of the two bytes before the coded one."""
    return (mix64(key >> np.uint64(8 * (depth - 1))) % np.uint64(shards)).astype(np.int64)


def pack_keys(key: np.ndarray) -> bytes:
    """Sorted numbers as their differences, by byte place, compressed."""
    return squeeze(np.diff(key, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unsqueeze(b, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts' sums."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _by_shard(key: np.ndarray, depth: int, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(shard, places of its keys, in order)``."""
    shard = gram_shard(key, depth, shards)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cut)):
        yield int(s), order[cut[s]:cut[s + 1]]


def gram_totals(docs: DataFrame, depth: int, shards: int) -> DataFrame:
    """``(shard, keys, counts)``: training occurrences of each gram, one row per shard."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def emit():
            k, c = _added(keys, counts)
            rows = [(s, pack_keys(k[at]), squeeze(c[at])) for s, at in _by_shard(k, depth, shards)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["shard", "keys", "counts"])

        for b in batches:
            data, offs = text_bytes(b.column("text"))
            for _, _, part, po in _runs(data, offs):
                k, c = np.unique(grams(part, po, depth)[0], return_counts=True)
                keys.append(k)
                counts.append(c.astype(np.int64))
                held += len(k)
                if held > 4 << 20:
                    merged = _added(keys, counts)
                    keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
                    if held > 2 << 20:
                        yield emit()
                        keys, counts, held = [], [], 0
        if held:
            yield emit()

    def total(t: pa.Table) -> pa.Table:
        k, c = _added([unpack_keys(x) for x in t.column("keys").to_pylist()], [unsqueeze(x, np.int64) for x in t.column("counts").to_pylist()])
        return pa.table({"shard": t.column("shard").slice(0, 1), "keys": pa.array([pack_keys(k)], pa.binary()), "counts": pa.array([squeeze(c)], pa.binary())})

    schema = "shard int, keys binary, counts binary"
    return docs.where("train").select("text").mapInArrow(count, schema).groupBy("shard").applyInArrow(total, schema)


def root_of(totals: DataFrame, depth: int) -> Root:
    """Depths 0 and 1 of the tree: at most 256 rows of 511 numbers reach the driver."""
    schema = "last int, weighted binary, counts binary"

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                rows = [(k, pack(w), pack(c)) for k, (w, c) in NodeTable(unpack_keys(keys), unsqueeze(counts, np.int64), depth).top().items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["last", "weighted", "counts"])

    def add(t: pa.Table) -> pa.Table:
        summed = [pack(np.sum([unpack(x, np.float64) for x in t.column(c).to_pylist()], axis=0)) for c in ("weighted", "counts")]
        return pa.table({"last": t.column("last").slice(0, 1), "weighted": pa.array(summed[:1], pa.binary()), "counts": pa.array(summed[1:], pa.binary())})

    children, counts = np.zeros((256, 255)), np.zeros((256, 256))
    for r in totals.select("keys", "counts").mapInArrow(tops, schema).groupBy("last").applyInArrow(add, schema).toLocalIterator():
        children[r["last"]], counts[r["last"]] = unpack(r["weighted"], np.float64), unpack(r["counts"], np.float64)
    return Root(children, counts)


# Words ---------------------------------------------------------------------

def word_totals(docs: DataFrame, bits: int) -> DataFrame:
    """``(shard, keys, counts)``: training occurrences of each word, one row
    per shard of the hash range."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            edges = np.searchsorted(k, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.array([0])
            edges = np.r_[edges, len(k)]
            some = np.flatnonzero(np.diff(edges))
            return pa.RecordBatch.from_arrays([
                pa.array(some.astype(np.int32)), pa.array([pack(k[edges[s]:edges[s + 1]]) for s in some], pa.binary()),
                pa.array([pack(c[edges[s]:edges[s + 1]].astype(np.int64)) for s in some], pa.binary())], names=["shard", "keys", "counts"])

        for b in batches:
            data, offs = text_bytes(b.column("text"))
            for _, _, part, po in _runs(data, offs):
                h, _ = word_hashes(part, po)
                held.append(h)
                size += len(h)
                if size > 4 << 20:
                    yield emit()
                    held, size = [], 0
        if size:
            yield emit()

    def total(t: pa.Table) -> pa.Table:
        k, c = summed(t)
        return pa.table({"shard": t.column("shard").slice(0, 1), "keys": pa.array([pack(k)], pa.binary()), "counts": pa.array([pack(c)], pa.binary())})

    schema = "shard int, keys binary, counts binary"
    return docs.where("train").select("text").mapInArrow(count, schema).groupBy("shard").applyInArrow(total, schema)


def summed(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a table's rows with the sums of their counts."""
    if not t.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = np.concatenate([unpack(x, np.uint64) for x in t.column("keys").to_pylist()])
    c = np.concatenate([unpack(x, np.int64) for x in t.column("counts").to_pylist()])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order (a sort is several times faster here than ``np.unique``'s hashing)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def coded_runs(data: np.ndarray, offs: np.ndarray, depth: int) -> list[tuple]:
    """``(word hashes, their offsets, grams, their offsets)`` of runs of texts."""
    return [(*word_hashes(part, po), *grams(part, po, depth)) for _, _, part, po in _runs(data, offs)]


def batch_keys(runs: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words (hashes) and grams of a batch of texts, sorted."""
    none = np.zeros(0, np.uint64)
    return tuple(distinct(np.concatenate([none, *(distinct(r[k]) for r in runs)])) for k in (0, 2))


class Places:
    """The places of keys in a sorted array that holds them all: a table by hash
    answers nearly all at once, a binary search the rest."""

    ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[(keys * self.ODD >> self.shift).astype(np.int64)] = np.arange(len(keys))

    def __call__(self, want: np.ndarray) -> np.ndarray:
        at = self.table[(want * self.ODD >> self.shift).astype(np.int64)]
        other = np.flatnonzero(self.keys[at] != want)
        at[other] = np.searchsorted(self.keys, want[other])
        return at


def requests(dealt: DataFrame, bits: int, depth: int) -> DataFrame:
    """``(batch, shard, keys)``: the distinct words of each batch, by shard, and
    behind the words' shards its distinct grams."""
    def run(t: pa.Table) -> pa.Table:
        words, parts = batch_keys(coded_runs(*text_bytes(t.column("text")), depth))
        shard = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
        some, first = np.unique(shard, return_index=True)
        cut = np.r_[first, len(words)]
        rows = [(int(s), pack(words[a:z])) for s, a, z in zip(some, cut[:-1], cut[1:])]
        rows += [((1 << bits) + s, pack_keys(parts[at])) for s, at in _by_shard(parts, depth, 1 << bits)]
        return pa.table({"batch": pa.array([t.column("batch")[0].as_py()] * len(rows), pa.int64()), "shard": pa.array([r[0] for r in rows], pa.int32()),
                         "keys": pa.array([r[1] for r in rows], pa.binary())})

    return dealt.groupBy("batch").applyInArrow(run, "batch long, shard int, keys binary")


def replies(asked: DataFrame, words: DataFrame, parts: DataFrame, bits: int, depth: int, root) -> DataFrame:
    """``(batch, shard, answers)``: a count for each word of a request, or a log
    probability (log10, 32 bits) for each gram."""
    def run(wanted: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if not wanted.num_rows:
            pass
        elif wanted.column("shard")[0].as_py() < 1 << bits:
            k, c = summed(known)
            for x in wanted.column("keys").to_pylist():
                want = unpack(x, np.uint64)
                at = np.minimum(np.searchsorted(k, want), max(len(k) - 1, 0))
                out.append(pack(np.where(k[at] == want, c[at], 0) if len(k) else np.zeros(len(want), np.int64)))
        else:
            k, c = _added([unpack_keys(x) for x in known.column("keys").to_pylist()], [unsqueeze(x, np.int64) for x in known.column("counts").to_pylist()])
            nodes = NodeTable(k, c, depth)
            for x in wanted.column("keys").to_pylist():
                want = unpack_keys(x)
                logs = np.concatenate([np.zeros(0), *(nodes.logs(want[a:a + 200_000], root.value) for a in range(0, len(want), 200_000))])
                out.append(squeeze(logs.astype("<f4").view(np.uint8).reshape(-1, 4).T))
        return pa.table({"batch": wanted.column("batch"), "shard": wanted.column("shard"), "answers": pa.array(out, pa.binary())})

    known = words.unionByName(parts.withColumn("shard", (F.col("shard") + (1 << bits)).cast("int")))
    return asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(run, "batch long, shard int, answers binary")


def score_texts(docs: DataFrame, held_out: Column, batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES, depth: int = DEPTH) -> DataFrame:
    """``(doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens,
    base_score, score)`` of every row; ``score`` is the model's log10
    probability of the text, ``base_score`` the words' unigram score."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    d = d.withColumn("train", ~F.col("held_out"))
    rows, size = text_size(d)
    batches = max(1, size // batch_bytes)
    bits = max(0, (size // shard_bytes).bit_length())
    parts = cut_lineage(gram_totals(d, depth, 1 << bits), "ctw_grams")
    root = d.sparkSession.sparkContext.broadcast(root_of(parts, depth))
    totals = cut_lineage(word_totals(d, bits), "ctw_words")
    know = totals.agg(F.sum(F.octet_length("keys") / 8).cast("long").alias("v")).first()["v"] or 0
    ends = d.where("train").count()
    words = _sum_counts(totals)
    n, v = words + ends, know + (ends > 0)
    dealt = d.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch"), "doc_id", "held_out", "text")
    answered = replies(requests(dealt, bits, depth), totals, parts, bits, depth, root)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        data, offs = text_bytes(texts.column("text"))
        got = sorted(zip(answers.column("shard").to_pylist(), answers.column("answers").to_pylist()))
        none = np.zeros(0, np.int64)
        count = np.concatenate([none, *(unpack(x, np.int64) for s, x in got if s < 1 << bits)])
        runs = coded_runs(data, offs, depth)
        keys, asked = batch_keys(runs)
        byte_logs = np.empty(len(asked))
        told = [np.ascontiguousarray(unsqueeze(x, np.uint8).reshape(4, -1).T).view("<f4").ravel() for s, x in got if s >= 1 << bits]
        for (_, at), logs in zip(_by_shard(asked, depth, 1 << bits), told):
            byte_logs[at] = logs
        word_logs, known = np.log10(count + ALPHA), count > 0
        tokens, familiar, base, score = [], [], [], []
        word_at, gram_at = Places(keys), Places(asked)
        for h, where, g, ends_at in runs:
            at = word_at(h)
            tokens.append(np.diff(where) + 1)
            familiar.append(_sums(known[at].astype(np.int64), where) + (ends > 0))
            base.append(_sums(word_logs[at], where) + np.log10(ends + ALPHA))
            score.append(_sums(byte_logs[gram_at(g)], ends_at))
        tokens, familiar, base, score = (np.concatenate(x) for x in (tokens, familiar, base, score))
        base = base - tokens * np.log10(n + ALPHA * (v + 1))
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_bytes": pa.array(np.diff(offs), pa.int64()),
                         "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(familiar, pa.int64()),
                         "train_tokens": pa.array(np.full(len(tokens), n), pa.int64()), "base_score": pa.array(base), "score": pa.array(score)})

    return dealt.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(
        run, "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _sums(x: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Sums of the runs between offsets, empty ones 0."""
    total = np.zeros(len(where) - 1, x.dtype)
    some = np.flatnonzero(np.diff(where))
    if len(some):
        total[some] = np.add.reduceat(x, where[:-1][some])
    return total


def _sum_counts(totals: DataFrame) -> int:
    """All occurrences in the shards' rows; one number a shard leaves its task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(unpack(x, np.int64).sum()) for x in b.column("counts").to_pylist()], pa.int64())], names=["n"])

    return totals.select("counts").mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
