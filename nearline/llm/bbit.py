"""Near-duplicates by b-bit MinHash.

A document's set is its distinct 3-word shingles (64-bit hashes of the whole
words).  128 minima are drawn per set; whole minima give 32 band keys of 4
rows, and only the 2 low bits of each (after a bijective mix) are retained,
packed into 32 bytes.  The similarity of two signatures is estimated by bit
counts and corrected for chance collisions (1 in 4); a pair that may reach
the threshold is confirmed on the full sets.

Sets that are equal become one row first.  Buckets are never paired up: all
members are linked to the bucket's smallest id, and the connected families of
these links hold every candidate pair.  A family's members are compared in
tasks: in tiles of two chunks when the family is large, so that a tile's size
is bounded whatever the family's, with union-find to skip pairs that are
connected already.  A tile gives a spanning forest of its true links (at most
one row per member), never its pairs.  Two documents at the threshold share
no band with a chance of 6e-11, and a true link is lost by the estimate with
a chance below 1e-5 per pair (``margin`` is 5 standard deviations).

Defined cases: a null or empty text, or one without words, has an empty set
and is linked with nothing; a text of one or two words has one shingle; rows
with equal ids are one node; a null id is never linked (its component is
null, it is kept); an empty table gives no rows.  Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import mix64, pack, text_bytes, unpack


@dataclass(frozen=True)
class NearParams:
    words: int = 3
    bands: int = 32
    rows: int = 4
    percent: int = 85               # linked from this similarity
    margin: float = 0.19            # of the estimate, below the threshold
    seed: int = 11
    chunk_rows: int = 1000          # members of a family in one chunk, and
    chunk_shingles: int = 1 << 20   # their shingles (8 bytes each)

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


CHUNK_EDGES = 500_000

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.arange(256, dtype=np.uint64) * _BASE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of each word, offsets of the documents in it)``."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offs[:-1][np.diff(offs) > 0]
    first[starts] = inside[starts]                       # a text's first byte begins a word
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)).astype(np.int64) + np.r_[at[0], np.zeros(len(at) - 1, np.int64)]) \
        if at[0] == 0 else np.concatenate([np.zeros(at[0], np.int64), np.arange(at[0], n) - np.repeat(at, np.diff(np.append(at, n)))])
    power = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    coded = np.where(inside, _BYTE[_LOWER[data]] * power[place], np.uint64(0))
    return mix64(np.add.reduceat(coded, at)), np.searchsorted(at, offs)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document in turn."""
    h, where = word_hashes(data, offs)
    n = len(h)
    whole = h
    for k in range(1, min(words, n)):                    # from the hash of k words to that of k + 1
        whole = mix64(whole[:n - k] + _STEP[k]) ^ h[k:]
    whole = mix64(whole)
    for a, z in zip(where[:-1].tolist(), where[1:].tolist()):
        if z - a >= words:
            yield np.unique(whole[a:z - words + 1])
        elif z > a:                                      # the whole short sequence is one shingle
            x = np.array([z - a], np.uint64)
            for w in h[a:z]:
                x = mix64(x * _BASE) ^ w
            yield x
        else:
            yield np.zeros(0, np.uint64)


class Sketcher:
    """Minima, band keys and packed low bits of shingle sets."""

    def __init__(self, p: NearParams):
        rng = np.random.default_rng(p.seed)
        self.p = p
        self.a = (rng.integers(0, 1 << 31, p.hashes, dtype=np.uint32) << np.uint32(1) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, p.hashes, dtype=np.uint32)[:, None]

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(self.p.hashes, 0xFFFFFFFF, np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for s in range(0, len(x), 2048):
            np.minimum(low, (self.a * x[None, s:s + 2048] + self.b).min(axis=1), out=low)
        return low

    def bands(self, minima: np.ndarray) -> np.ndarray:
        m = minima.reshape(self.p.bands, self.p.rows).astype(np.uint64)
        key = np.arange(self.p.bands, dtype=np.uint64) * _BASE
        for r in range(self.p.rows):
            key = mix64(key ^ m[:, r])
        return key.view(np.int64)

    def low_bits(self, minima: np.ndarray) -> np.ndarray:
        two = (mix64(minima.astype(np.uint64)) & np.uint64(3)).reshape(-1, 32)
        return (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)


def estimate(sig: np.ndarray, others: np.ndarray, hashes: int) -> np.ndarray:
    """Similarity of one packed signature with others, corrected for the one
    match in four that chance gives."""
    x = sig[None, :] ^ others
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)
    match = 1 - differ / hashes
    return (match - 0.25) / 0.75


def sketch(docs: DataFrame, p: NearParams) -> DataFrame:
    """``(doc_id, n, set_hash, bands, sig)`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = Sketcher(p)
        for b in batches:
            data, offs = text_bytes(b.column("text"))
            n, digest, bands, sig = [], [], [], []
            for lo, hi, part, po in _runs(data, offs):
                for s in shingle_sets(part, po, p.words):
                    n.append(len(s))
                    if not len(s):
                        digest.append(None), bands.append(None), sig.append(None)
                        continue
                    m = sk.minima(s)
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(sk.bands(m))
                    sig.append(pack(sk.low_bits(m)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                              pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                                             names=["doc_id", "n", "set_hash", "bands", "sig"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, n long, set_hash binary, bands array<long>, sig binary"))


def _runs(data: np.ndarray, offs: np.ndarray, size: int = 1 << 20):
    """Whole texts in runs of about ``size`` bytes."""
    a = 0
    while a < len(offs) - 1:
        z = max(a + 1, int(np.searchsorted(offs, offs[a] + size, side="right")) - 1)
        yield a, z, data[offs[a]:offs[z]], offs[a:z + 1] - offs[a]
        a = z


def contract(edges: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """A star forest (node, smallest node reached) of the edges of one task,
    taken up by and by; what is held is a forest and at most ``chunk`` edges."""
    def forest(parts: list[np.ndarray]) -> np.ndarray:
        pairs = np.concatenate(parts)
        nodes, at = np.unique(pairs, return_inverse=True)
        a, b = at.reshape(pairs.shape).T
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            while (new != (up := new[new])).any():
                new = up
            if (new == label).all():
                break
            label = new
        inner = np.flatnonzero(label != np.arange(len(nodes)))
        return np.stack([nodes[inner], nodes[label[inner]]], axis=1)

    parts, held = [], 0
    for batch in edges:
        parts.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
        held += len(parts[-1])
        if held >= chunk:
            parts, held = [forest(parts)], 0
    if parts:
        f = forest(parts)
        yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1])], names=["u", "v"])


def components(edges: DataFrame, name: str, chunk: int = CHUNK_EDGES) -> DataFrame:
    """``(u, v)``: every node of the graph but the roots with the smallest
    node of its component.

    Tasks first contract their own edges to forests.  These are contracted
    again in chunks of about ``chunk`` edges; while there are several chunks,
    rounds of large and small stars follow, each half a combinable minimum
    and an equi-join, until every component is a star.  Edges are written
    between rounds; their number never grows.
    """
    e = cut_lineage(edges.where("a <> b").select("a", "b").mapInArrow(lambda it: contract(it, chunk), "u long, v long"), name)
    while True:
        parts = -(-max(e.count(), 1) // chunk)
        e = cut_lineage(e.coalesce(parts).mapInArrow(lambda it: contract(it, chunk), "u long, v long"), name)
        if parts == 1:
            return e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.where("u <> v").distinct(), name)
        inner = e.select(F.col("v").alias("u")).distinct().join(e, "u", "left_semi")
        if inner.isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty():
            return e                                     # stars: no root has a parent, no node two


def tile_links(n: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray, p: NearParams) -> list[tuple[int, int]]:
    """A spanning forest of the links among a tile's members.  ``side``: the
    chunk of each member; in a tile of two chunks only pairs across count."""
    order = np.argsort(n, kind="stable")
    n, sig, side = n[order], sig[order], side[order]
    sets = [sets[i] for i in order]
    m = len(n)
    cross = side.min() != side.max() if m else False
    # Shingles of one member only are in no intersection; the others are numbered.
    values, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True) if m else (None, None, None)
    dense = np.cumsum(count > 1) - 1
    shared = [dense[x][count[x] > 1] for x in np.split(number, np.cumsum([len(s) for s in sets])[:-1])]
    width = int((count > 1).sum())
    bitmap = None
    if m * (width // 64 + 1) * 8 <= 64 << 20:               # as bits if they fit; the counts are the same either way
        rows = np.zeros((m, (width // 64 + 1) * 8), np.uint8)
        for i, s in enumerate(shared):
            flags = np.zeros(rows.shape[1] * 8, bool)
            flags[s] = True
            rows[i] = np.packbits(flags)
        bitmap = rows.view(np.uint64)
    label = np.arange(m)
    out = []
    floor = p.percent / 100 - p.margin
    for i in range(m):
        top = int(np.searchsorted(n, n[i] * 100 // p.percent, side="right"))     # larger sets cannot reach the threshold
        js = np.arange(i + 1, top)
        js = js[label[js] != label[i]]
        if cross:
            js = js[side[js] != side[i]]
        if len(js):
            js = js[estimate(sig[i], sig[js], p.hashes) >= floor]
        if not len(js):
            continue
        if bitmap is not None:
            inter = np.concatenate([np.bitwise_count(bitmap[i][None, :] & bitmap[js[s:s + 256]]).sum(axis=1, dtype=np.int64)
                                    for s in range(0, len(js), 256)])
        else:
            inter = np.array([len(np.intersect1d(shared[i], shared[j], assume_unique=True)) for j in js])
        for j in js[100 * inter >= p.percent * (n[i] + n[js] - inter)]:
            if label[j] != label[i]:
                out.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return out


def near_duplicates(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row."""
    sketches = cut_lineage(sketch(docs, p), "near_sketches")
    reps = cut_lineage(sketches.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_hash")
                       .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "near_sets")
    keys = reps.select("rep", F.explode("bands").alias("key"))
    heads = cut_lineage(keys.groupBy("key").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "near_buckets")
    stars = keys.join(heads, "key").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    families = components(stars, "near_families")
    members = families.select(F.col("u").alias("rep"), F.col("v").alias("family")).unionByName(
        families.select(F.col("v").alias("rep"), F.col("v").alias("family")).distinct())
    member_rows = cut_lineage(members.join(reps.drop("bands"), "rep"), "near_members")
    links = cut_lineage(family_links(docs, member_rows, p), "near_links")
    roots = components(links, "near_roots")
    # A document's node is the smallest id with its set.
    node = reps.select("set_hash", "rep").join(roots.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left") \
        .select("set_hash", F.coalesce("root", "rep").alias("root"))
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return (sketches.select("doc_id", F.col("n").alias("n_shingles"), "set_hash").join(node, "set_hash", "left")
            .select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(root == F.col("doc_id"), F.lit(True)).alias("kept")))


def family_links(docs: DataFrame, members: DataFrame, p: NearParams) -> DataFrame:
    """``(a, b)``: spanning forests of the true links of every family."""
    size = members.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / p.chunk_rows), F.ceil(F.sum("n") / p.chunk_shingles)).cast("int").alias("chunks"))
    chosen = members.join(size, "family").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("text is not null").join(chosen, "rep")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_bytes(b.column("text"))
            want = b.column("set_hash").to_pylist()
            got, keep = [], []
            for lo, hi, part, po in _runs(data, offs):
                for i, s in enumerate(shingle_sets(part, po, p.words), lo):
                    if xxhash.xxh3_128_digest(s.tobytes()) == want[i]:      # another text may have the same id
                        keep.append(i)
                        got.append(pack(s))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(keep, pa.int64())) for c in ("family", "rep", "n", "sig", "chunk", "chunks")],
                                              pa.array(got, pa.binary())], names=["family", "rep", "n", "sig", "chunk", "chunks", "shingles"])

    rows = texts.select("family", "rep", "n", "sig", "chunk", "chunks", "set_hash", "text").mapInArrow(
        sets, "family long, rep long, n long, sig binary, chunk int, chunks int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiles = (rows.withColumn("other", other).withColumn("ti", F.least("chunk", "other")).withColumn("tk", F.greatest("chunk", "other")))

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("rep").to_pylist()
        n = t.column("n").to_numpy()
        sig = np.stack([unpack(x, np.uint64) for x in t.column("sig").to_pylist()])
        shingles = [unpack(x, np.uint64) for x in t.column("shingles").to_pylist()]
        found = tile_links(n, sig, shingles, t.column("chunk").to_numpy(), p)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return (tiles.select("family", "ti", "tk", "rep", "n", "sig", "chunk", "shingles")
            .groupBy("family", "ti", "tk").applyInArrow(run, "a long, b long"))


def drop_near_duplicates(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """The rows of ``docs`` but those whose component has a smaller id; rows
    that repeat an id share its fate."""
    gone = near_duplicates(docs, p).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def one_of_each_group(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """Like :func:`drop_near_duplicates`, but by rows: of rows that repeat an
    id and a text one stays (the smallest by the other columns), texts that
    share an id are compared one by one, and so are rows with a null id; these, and
    all texts of an id but its smallest, come after all others.  Ids lie below 2^62."""
    node = F.col("doc_id").cast("long")
    count = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    twice = cut_lineage(count.where("c > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id")), "near_twice")
    if twice.isEmpty():
        return drop_near_duplicates(docs, p)
    again = docs.join(twice.where("__id IS NOT NULL"), F.col("doc_id") == F.col("__id"), "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = again.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("__zero"), *rest)).alias("__rest")).select("doc_id", "text", "__rest.*")
    first = again.groupBy("doc_id").agg(F.min("text").alias("__first"))
    one = one.join(first, "doc_id").withColumn("__node", F.when(F.col("text").eqNullSafe(F.col("__first")), node))
    plain = docs.where("doc_id IS NOT NULL").join(twice, F.col("doc_id") == F.col("__id"), "left_anti")
    top = docs.agg(F.max(node).alias("top")).first()["top"] or 0
    columns = [*docs.columns, "__node"]
    named = one.select(*columns).unionByName(docs.where("doc_id IS NULL").withColumn("__node", F.lit(None).cast("long")))
    # Numbered once and written, so every later read sees the same numbers.
    named = cut_lineage(named.withColumn("__node", F.coalesce("__node", F.lit(max(top, 0) + 1) + F.monotonically_increasing_id())), "near_rows")
    rows = plain.withColumn("__node", node).unionByName(named)
    gone = near_duplicates(rows.select(F.col("__node").alias("doc_id"), "text"), p).where("NOT kept").select(F.col("doc_id").alias("__gone"))
    return rows.join(gone, F.col("__node") == F.col("__gone"), "left_anti").select(*docs.columns)
