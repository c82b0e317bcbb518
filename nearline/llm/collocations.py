"""Phrase collocations (operator 11) from a weighted de Bruijn graph of words.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and
pieces into words.  Per language, the longest grams (three words) are edges
between nodes of two words that overlap in one.

Method.  Tasks read texts in blocks of at most ``BLOCK`` words and build each
block's graph as sorted arrays:

1. equal three-word grams become one edge with their number as weight;
2. unary paths are compacted: edges that follow one another over a node with
   one edge in, one edge out and equal weights form a path of one weight;
3. the count of a two-word gram is its node's flow: the weight of its path
   inside a path, else the sum of the paths that leave it, plus the pieces
   that end with it; the count of a word is the flow of the nodes that begin
   with it, plus the pieces that end with it.

Counts of blocks add up, so grams of all lengths travel to shards by a hash of
their words, as compressed rows of one block and shard (a row has its own list
of words, and its grams as places in it).  A gram's rows, however
frequent it is, are one number a block, and a frequent word or word pair is
spread over all shards by the other words of its grams.  The number of shards
follows the bytes of text.  A shard adds up its grams and returns those of
``least`` or more; since no part of a phrase is rarer than the phrase, these
hold every count that a candidate needs.

Scores are exact (decimals of 38 digits, whole division).

Defined results: a null text is empty, a null language is ``und``; empty texts
and an empty table give no rows; very long texts are cut into blocks with the
next words as context; repeated rows count as often as they occur; other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import cut_lineage
from .common import mix64, squeeze, text_size, unsqueeze

BLOCK = 1_000_000                       # words of a block
SHARD_BYTES = 24 << 20                  # text bytes a shard stands for
ENDS = b".,;:!?\n\x0b\x0c\r"            # fixed: characters between pieces
_TO_END = bytes.maketrans(ENDS, b"\n" * len(ENDS))


@dataclass(frozen=True)
class PhraseParams:
    least: int = 10                     # occurrences of a candidate
    overlap_percent: int = 50           # of a candidate inside a longer one: dropped
    top: int = 2000                     # phrases returned per language


# ------------------------------------------------------------ one block's graph

def words_of(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """``(words, piece number of every word)`` of texts joined by line ends."""
    data = data.lower().translate(_TO_END)
    a = np.frombuffer(data, np.uint8)
    gap = (a == 32) | (a == 9) | (a == 10)
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    return data.split(), np.searchsorted(np.flatnonzero(a == 10), starts)


@dataclass
class Graph:
    """Counts of a block, as indexes into its ``words``."""
    words: pa.Array
    edges: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]      # three words, weight
    nodes: tuple[np.ndarray, np.ndarray, np.ndarray]                  # two words, count
    counts: np.ndarray                                                # of every word
    paths: int                                                        # after compaction


def block_graph(words: list[bytes], piece: np.ndarray, own: int) -> Graph:
    """The graph of the grams that start in the first ``own`` words; at most two
    words follow as context."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    w, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    often = np.argsort(-np.bincount(w, minlength=size), kind="stable")   # frequent words get small numbers
    rank = np.empty(size, np.int64)
    rank[often] = np.arange(size)
    w = rank[w]
    n = len(w)
    pair = piece[:-1] == piece[1:]                                    # word i and i + 1 are one piece's
    triple = pair[:-1] & pair[1:]
    two = np.flatnonzero(pair)
    keys, at = np.unique(w[two] * size + w[two + 1], return_inverse=True)
    node = np.full(n, -1)
    node[two] = at
    first, second = keys // size, keys % size

    start = np.flatnonzero(triple[:own])
    edge, seen, weight = np.unique(node[start] * size + w[start + 2], return_index=True, return_counts=True)
    seen = start[seen]                                                # where an edge occurs first
    source, target = node[seen], node[seen + 1]

    # Unary paths: in the order of first occurrence, an edge goes on with the next one.
    unary = (np.bincount(source, minlength=len(keys)) == 1) & (np.bincount(target, minlength=len(keys)) == 1)
    order = np.argsort(seen, kind="stable")
    a, b = order[:-1], order[1:]
    goes_on = (seen[b] == seen[a] + 1) & unary[target[a]] & (weight[a] == weight[b]) & (source[b] == target[a])
    heads = order[np.concatenate([[True], ~goes_on])] if len(order) else order

    # Node flow: branching nodes send out paths, inner nodes have their path's weight.
    flow = np.bincount(source[heads], weights=weight[heads], minlength=len(keys)).astype(np.int64)
    inner = b[goes_on]
    flow[source[inner]] = weight[inner]
    ends = two[(two < own) & ~np.concatenate([triple, [False]])[two]]
    flow += np.bincount(node[ends], minlength=len(keys))              # pieces that end with the pair
    last = np.flatnonzero(~np.concatenate([pair, [False]])[:own])
    counts = (np.bincount(first, weights=flow, minlength=size) + np.bincount(w[last], minlength=size)).astype(np.int64)
    used = flow > 0                                                   # pairs of the context alone have none
    return Graph(coded.dictionary.take(pa.array(often)), (first[source], second[source], edge % size, weight), (first[used], second[used], flow[used]), counts, len(heads))


def _blocks(words: list[bytes], piece: np.ndarray):
    for a in range(0, len(words), BLOCK):
        own = min(BLOCK, len(words) - a)
        yield block_graph(words[a:a + own + 2], piece[a:a + own + 2], own)


# ------------------------------------------------------------ blocks to shards

def _planes(a: np.ndarray) -> bytes:
    """Numbers below 2**32 by byte place, compressed."""
    return squeeze(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(unsqueeze(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _packets(lang: str, graph: Graph, shards: int):
    """The rows of one block: ``(shard, lang, total words, vocabulary, first,
    second, third, counts)``.  Places count from 1; 0 is no word."""
    have = np.flatnonzero(graph.counts)
    none = lambda n: np.zeros(n, np.int64)
    e, d = graph.edges, graph.nodes
    a = np.concatenate([e[0], d[0], have]) + 1
    b = np.concatenate([e[1] + 1, d[1] + 1, none(len(have))])
    c = np.concatenate([e[2] + 1, none(len(d[0]) + len(have))])
    count = np.concatenate([e[3], d[2], graph.counts[have]]).astype(np.int64)
    if not len(a):
        return
    h = np.concatenate([[0], np.fromiter((xxhash.xxh64_intdigest(x) for x in graph.words.to_pylist()), np.uint64, len(graph.words))]).astype(np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    shard = (mix64(mix64(mix64(h[a]) * odd + h[b]) * odd + h[c]) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    total, size = int(graph.counts.sum()), len(graph.words) + 1
    for s in np.flatnonzero(np.diff(cut)):
        mine = order[cut[s]:cut[s + 1]]
        x, y, z = a[mine], b[mine], c[mine]
        used = np.zeros(size, bool)
        used[x] = used[y] = used[z] = True
        used[0] = True
        place = np.cumsum(used) - 1
        x, y, z = place[x], place[y], place[z]
        o = np.lexsort((z, y, x))
        x, y, z = x[o], y[o], z[o]
        vocabulary = b"\n".join(graph.words.take(pa.array(np.flatnonzero(used[1:]))).to_pylist())
        yield (int(s), lang, total, squeeze(np.frombuffer(vocabulary, np.uint8)), _planes(np.diff(x, prepend=0)), _planes(y), _planes(z), squeeze(count[mine][o]))
        total = 0                                                     # a block's words are told once


PACKET = "shard int, lang string, words long, vocabulary binary, first binary, second binary, third binary, counts binary"


def _block_rows(shards: int):
    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("words", pa.int64()),
                        *[(n, pa.binary()) for n in ("vocabulary", "first", "second", "third", "counts")]])

    def sent(rows):
        rows = [list(c) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def flush(lang):
            texts = held.pop(lang)
            size.pop(lang)
            words, piece = words_of(b"\n".join(texts))
            del texts
            for graph in _blocks(words, piece):
                rows = list(_packets(lang, graph, shards))
                for a in range(0, len(rows), 256):
                    yield sent(rows[a:a + 256])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text")):
                raw = text.as_buffer()
                if raw is None or not raw.size:
                    continue
                held.setdefault(lang, []).append(raw.to_pybytes())
                size[lang] = size.get(lang, 0) + raw.size
                if size[lang] > 6 * BLOCK or sum(size.values()) > 18 * BLOCK:
                    yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)

    return run


def _added(rows: pa.Table, least: int) -> tuple[list[str], np.ndarray]:
    """The phrases of one shard and language that occur often enough, and their counts."""
    vocabularies = [unsqueeze(v, np.uint8).tobytes().split(b"\n") for v in rows.column("vocabulary").to_pylist()]
    coded = pa.array([w for v in vocabularies for w in v], pa.binary()).dictionary_encode()
    number = np.split(coded.indices.to_numpy().astype(np.int64) + 1, np.cumsum([len(v) for v in vocabularies])[:-1])
    size = len(coded.dictionary) + 1
    del vocabularies
    parts = []
    for own, first, second, third in zip(number, *(rows.column(c).to_pylist() for c in ("first", "second", "third"))):
        own = np.concatenate([[0], own])
        parts.append([own[np.cumsum(_from_planes(first))], own[_from_planes(second)], own[_from_planes(third)]])
    x, y, z = (np.concatenate(p) for p in zip(*parts))
    count = np.concatenate([unsqueeze(c, np.int64) for c in rows.column("counts").to_pylist()])
    del parts
    pairs, pair = np.unique(x * size + y, return_inverse=True)        # so that a gram is one number, whatever the vocabulary
    key = pair * size + z
    del x, y, z, pair
    order = np.argsort(key)
    key, count = key[order], count[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    total = np.add.reduceat(count, heads)
    key, total = key[heads][total >= least], total[total >= least]
    pair, z = pairs[key // size], key % size
    words = [""] + [w.decode("utf-8", "replace") for w in coded.dictionary.to_pylist()]
    return [" ".join(words[i] for i in g if i) for g in zip((pair // size).tolist(), (pair % size).tolist(), z.tolist())], total


def _shard_sums(least: int):
    def run(t: pa.Table) -> pa.Table:
        out = []
        for lang in sorted(set(t.column("lang").to_pylist())):
            rows = t.filter(pa.compute.equal(t.column("lang"), lang))
            phrases, total = _added(rows, least)
            words = sum(rows.column("words").to_pylist())
            out.append(pa.table({"lang": pa.array([lang] * (len(phrases) + 1), pa.string()), "phrase": pa.array([*phrases, ""], pa.string()),
                                 "f": pa.array([*total.tolist(), words], pa.int64())}))
        return pa.concat_tables(out)

    return run


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10) -> DataFrame:
    """``(lang, phrase, f)``: grams of one to three words that occur ``least``
    times or more; the empty phrase has the number of all words, in one or
    several rows per language."""
    _, size = text_size(docs, text_col)
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // SHARD_BYTES))
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    packets = rows.mapInArrow(_block_rows(shards), PACKET).repartitionById(shards, "shard")
    return packets.groupBy("shard").applyInArrow(_shard_sums(least), "lang string, phrase string, f long")


# ------------------------------------------------------------ candidates

def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", params: PhraseParams = PhraseParams()) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of every
    language, by their lowest-scoring cut ``10^6 * a^2 / (l * r)``."""
    grams = cut_lineage(gram_counts(docs, text_col, lang_col, params.least), "grams")
    total = grams.where("phrase = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    grams = grams.where("phrase <> ''").withColumn("w", F.split("phrase", " "))
    phrases = grams.where(F.size("w") > 1).withColumnRenamed("f", "a")
    said = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    # Words inside a longer candidate: only pairs inside triples, whose counts the triples send.
    inside = (phrases.where(F.size("w") == 3).select("lang", "a", F.explode(F.array(said(1, 2), said(2, 2))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (phrases.join(inside, ["lang", "phrase"], "left")
            .where((F.size("w") == 3) | F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * params.overlap_percent)))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.when(F.size("w") == 2, F.array(F.struct(F.lit(1).alias("k"), said(1, 1).alias("x"), said(2, 1).alias("y"))))
                       .otherwise(F.array(F.struct(F.lit(1).alias("k"), said(1, 1).alias("x"), said(2, 2).alias("y")),
                                          F.struct(F.lit(2).alias("k"), said(1, 2).alias("x"), said(3, 1).alias("y"))))).alias("c")).select("lang", "phrase", "a", "c.*")
    cuts = cut_lineage(cuts, "cuts")
    part = grams.select("lang", "phrase", "f")
    # A frequent word begins or ends very many candidates: its rows are spread.
    scored = salted_join(cuts, part.select("lang", F.col("phrase").alias("x"), F.col("f").alias("l")), ["lang", "x"], "inner", salt_by=["phrase", "k"])
    scored = salted_join(scored, part.select("lang", F.col("phrase").alias("y"), F.col("f").alias("r")), ["lang", "y"], "inner", salt_by=["phrase", "k"])
    scored = scored.withColumn("score", exact_score("a", "l", "r"))
    best = (scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
            .select("lang", "phrase", "a", "b.l", "b.r", "b.score"))
    return _first(best, params.top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def exact_score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(10^6 * a * a / (l * r)) in whole decimals; ``div`` rounds nothing."""
    return F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0)) "
                  f"div (CAST({l} AS DECIMAL(18,0)) * CAST({r} AS DECIMAL(18,0)))")


def _first(best: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of every language with their rank.  A language
    may hold most rows: its phrases are ranked in slices first, in ever fewer
    ones, and only the first ``top`` of every slice go on."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    n = int(best.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    for slices in sorted({n, max(4, int(n ** 0.5)), 4}, reverse=True):
        best = (best.withColumn("__slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
                .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__slice").orderBy(*order)))
                .where(F.col("rank") <= top).drop("rank", "__slice"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
