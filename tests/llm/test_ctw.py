"""Context-tree weighting against the definition, unigrams against Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import nearline.llm as llm
from nearline.llm import ctw
from nearline.llm.common import text_bytes
from nearline.llm.context_tree import NodeTable, Root, grams

LOWER = {i: i + 32 for i in range(65, 91)}


class Tree:
    """The definition: counts in dictionaries, weighted probabilities by recursion."""

    def __init__(self, texts, depth=2):
        self.depth, self.n = depth, {}
        for t in texts:
            for ctx, bit, node in self.steps(t):
                for d in range(depth + 1):
                    self.n.setdefault((ctx[depth - d:], node), [0, 0])[bit] += 1
        self.below = {}
        for ctx, node in self.n:
            if ctx:
                self.below.setdefault((ctx[1:], node), []).append(ctx)

    def steps(self, t):
        b = bytes(self.depth) + t.translate(LOWER).encode() + b"\0"
        for k in range(self.depth, len(b)):
            node = 1
            for j in range(7, -1, -1):
                bit = b[k] >> j & 1
                yield b[k - self.depth:k], bit, node
                node = 2 * node + bit

    def block(self, ctx, node):
        a, b = self.n[ctx, node]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, ctx, node):
        own = self.block(ctx, node)
        if len(ctx) == self.depth:
            return own
        return np.logaddexp(own, sum(self.weighted(c, node) for c in self.below[ctx, node])) - math.log(2)

    def one(self, ctx, node, d=0):
        here = ctx[self.depth - d:]
        if (here, node) not in self.n:
            return 0.5
        a, b = self.n[here, node]
        kt = (b + .5) / (a + b + 1)
        if d == self.depth:
            return kt
        beta = math.exp(self.block(here, node) - sum(self.weighted(c, node) for c in self.below[here, node]))
        return (beta * kt + self.one(ctx, node, d + 1)) / (beta + 1)

    def score(self, t):
        return sum(math.log10(p if bit else 1 - p) for ctx, bit, node in self.steps(t) for p in [self.one(ctx, node)])


def unigrams(train, texts):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) + [None]
    c = Counter(w for t in train for w in split(t))
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + .1) / (n + .1 * (v + 1))) for x in w)) for w in map(split, texts)]


TEXTS = ["abracadabra Abra", "", None, "é\0é\nabra", "the cat the hat", "unseen zebra", " ", "the cat the hat"]


def test_definition(spark):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id").isin(5, 6)
    train = [t or "" for i, t in rows if i not in (5, 6)]
    base = unigrams(train, [t or "" for t in TEXTS])
    for batch, shard, depth in ((1 << 20, 1 << 20, 6), (20, 10, 6), (20, 1 << 20, 2), (1 << 20, 5, 3), (1 << 20, 1 << 20, 7)):
        tree = Tree(train, depth)
        got = ctw.score_texts(df, held, batch, shard, depth).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_tokens, r.n_known, r.train_tokens) == base[r.doc_id][:3]
            assert math.isclose(r.base_score, base[r.doc_id][3], rel_tol=1e-9)
            assert math.isclose(r.score, tree.score(TEXTS[r.doc_id] or ""), rel_tol=1e-5)


def test_probabilities_sum_to_one():
    """Over all 256 bytes, after contexts seen and unseen; counts beyond the tables of logs too."""
    key, _ = grams(*text_bytes(pa.array(TEXTS, pa.string())), 6)
    key, count = np.unique(key, return_counts=True)
    for times in (1, 100_000):
        table = NodeTable(key, count * times, 6)
        children, counts = np.zeros((256, 255)), np.zeros((256, 256))
        for b, (w, c) in table.top().items():
            children[b], counts[b] = w, c
        root = Root(children, counts)
        for before in (b"abraca", b"zzzzzz", b"\0\0\0\0\0t", b"e cat "):
            context = sum(c << 8 * (k + 1) for k, c in enumerate(before))
            logs = table.logs(np.array([context | x for x in range(256)], np.uint64), root)
            assert math.isclose((10.0 ** logs).sum(), 1, rel_tol=1e-9)


def test_block_probabilities():
    from nearline.llm.context_tree import block_log
    z, o = np.array([0, 1, 5, 70_000, 65_535, 10 ** 9]), np.array([0, 0, 9, 3, 1, 10 ** 9])
    want = [math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(z.tolist(), o.tolist())]
    assert np.allclose(block_log(z, o), want, rtol=1e-9, atol=1e-9)


def test_edge_tables(spark, docs, no_docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    assert ctw.score_texts(docs, held).count() == docs.count()
    assert ctw.score_texts(no_docs, held).count() == 0
    untrained = ctw.score_texts(docs.where("doc_id = 8"), F.lit(True)).collect()
    assert [r.n_known for r in untrained] == [0, 0] and all(math.isclose(r.score, -10 * 8 * math.log10(2), rel_tol=1e-6) for r in untrained)


def test_query_on_the_small_table(spark, sf):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in text}
    got = {r.doc_id: r for r in llm.QUERIES["op7_context_tree_score"](spark, sf).collect()}
    base = dict(zip(text, unigrams([t for i, t in text.items() if not held[i]], list(text.values()))))
    for i, r in got.items():
        assert r.held_out == held[i] and (r.n_tokens, r.n_known, r.train_tokens) == base[i][:3] and math.isclose(r.base_score, base[i][3], rel_tol=1e-9)
    # A held-out byte costs well under the 8 bits of no model.
    bits = -sum(r.score for i, r in got.items() if held[i]) / math.log10(2) / sum(len(t.encode()) + 1 for i, t in text.items() if held[i])
    assert bits < 3.2


def test_deep_contexts_beat_the_unigrams(spark):
    """On held-out texts, the trees of depth 6 code better than words drawn by their frequency, and than two bytes of context."""
    got = llm.QUERIES["op7_context_tree_score"](spark, "/root/testdata/sf0.1").where("held_out").agg(
        F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert got["score"] > got["base"] and got["score"] / got["n"] > -4.0
