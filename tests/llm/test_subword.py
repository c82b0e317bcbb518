"""Quality classifier: features by definition, scores, held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

import nearline.llm as llm
from nearline.llm import subword
from nearline.llm.common import text_bytes


def test_features_do_not_depend_on_neighbours():
    """A text's features are the same alone and between others."""
    import pyarrow as pa
    p = subword.SubwordParams()
    texts = ["ab cd", "", "é  x", None, "one two three " * 50, " "]

    def counts(col):
        data, offs = text_bytes(pa.array(col, pa.string()))
        out = [{} for _ in col]
        for f, d in subword.features(data, offs, p):
            for b, k in zip(f.tolist(), d.tolist()):
                out[k][b] = out[k].get(b, 0) + 1
        return out

    together = counts(texts)
    assert together == [counts([t])[0] for t in texts]
    assert sum(together[0].values()) == 4 + 3 + 2 + 2            # n-grams of 2, 3, 4 bytes and two words


def test_edge_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (7, 1), (12, 0), (12, 0), (13, None), (None, 1), (4, 0), (99, 1)], "doc_id long, quality int")
    p = subword.SubwordParams(epochs=30)
    model = subword.train(docs, labels, "quality", F.lit(True), p)
    got = subword.score(docs, model, p).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] > 0.5 > by[12]
    assert by[4] == by[5]                                        # null and empty: the bias alone
    assert subword.score(no_docs, model, p).count() == 0
    blank = subword.train(docs, labels.limit(0), "quality", F.lit(True), p)
    assert {r.score for r in subword.score(docs, blank, p).collect()} == {0.5}


def test_one_class(spark, docs):
    labels = spark.createDataFrame([(1, 1), (7, 1)], "doc_id long, quality int")
    model = subword.train(docs, labels, "quality", F.lit(True))
    assert all(r.score > 0.9 for r in subword.score(docs, model).collect())


def test_training_does_not_depend_on_partitions(docs, spark):
    labels = spark.createDataFrame([(1, 1), (7, 1), (12, 0), (11, 0)], "doc_id long, quality int")
    a, b = (subword.train(d, labels, "quality", F.lit(True)) for d in (docs, docs.repartition(5)))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    r = llm.QUERIES["op8_quality_classifier"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    good, bad = [x.score for x in r if x.quality == 1], [x.score for x in r if x.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.85 and np.mean([x.predicted == x.quality for x in r]) >= 0.9


def slow_features(text, p):
    """Buckets of one text by the definition, in plain integers."""
    data, full = (text or "").encode(), (1 << 64) - 1
    odd = 0x9E3779B97F4A7C15
    out = []
    for n in p.ngrams:
        out += [((int.from_bytes(data[i:i + n], "big") + (n << 40)) * odd & full) >> (64 - p.bits) for i in range(len(data) - n + 1)]
    for word in data.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" "):
        if word:
            x = sum((c + 1) * pow(odd, (k & 63) + 1, 1 << 64) for k, c in enumerate(word)) & full
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                x = (x ^ (x >> shift)) * factor & full
            out.append(x >> (64 - p.bits))
    return out


def slow_model(rows, p):
    """The descent in plain Python, number by number."""
    rng = np.random.default_rng(p.seed)
    emb = [[float(x) for x in r] for r in rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)]
    layer = [[-0.5, 0.5]] + [[0.0, 0.0] for _ in range(p.dim - 1)]
    bias, step = [0.0, 0.0], 0
    steps = p.epochs * -(-len(rows) // p.batch)
    for _ in range(p.epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), p.batch):
            part, rate = [rows[i] for i in order[s:s + p.batch]], p.rate * (1 - step / steps)
            step += 1
            grads = []
            for label, feats in part:
                weight = {b: feats.count(b) / len(feats) for b in set(feats)}
                mean = [sum(w * emb[b][d] for b, w in weight.items()) for d in range(p.dim)]
                z = [sum(m * layer[d][c] for d, m in enumerate(mean)) + bias[c] for c in (0, 1)]
                e = [np.exp(v - max(z)) for v in z]
                g = [e[c] / sum(e) - (c == label) for c in (0, 1)]
                grads.append((weight, mean, g, [sum(g[c] * layer[d][c] for c in (0, 1)) for d in range(p.dim)]))
            for d in range(p.dim):
                for c in (0, 1):
                    layer[d][c] -= rate * sum(m[d] * g[c] for _, m, g, _ in grads) / len(part)
            for c in (0, 1):
                bias[c] -= rate * sum(g[c] for _, _, g, _ in grads) / len(part)
            for weight, _, _, back in grads:
                for b, w in weight.items():
                    for d in range(p.dim):
                        emb[b][d] -= rate * p.buckets ** 0.5 / 16 * w * back[d]
    return [sum(e[d] * (layer[d][1] - layer[d][0]) for d in range(p.dim)) for e in emb], bias[1] - bias[0]


def test_scores_by_brute_force(spark):
    """Model and scores equal a plain-Python descent over plainly computed features."""
    p = subword.SubwordParams(bits=7, dim=3, epochs=4, batch=4, rate=0.4)
    good, bad = "the river runs past the old mill", "$$$ click here $$$ free"
    texts = [(i, f"{good} number {i} é" if i % 2 else f"{bad} {i} {i}") for i in range(14)] + [(50, ""), (51, None), (52, good * 30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    model = subword.train(docs, labels, "quality", F.lit(True), p)
    weights, bias = slow_model([(i % 2, slow_features(t, p)) for i, t in texts[:10]], p)
    assert np.allclose(model[0], weights, atol=2e-3) and abs(model[1] - bias) < 2e-3
    for r in subword.score(docs, model, p).collect():
        feats = slow_features(dict(texts)[r.doc_id], p)
        odds = (sum(weights[b] for b in feats) / len(feats) if feats else 0) + bias
        assert abs(r.score - 1 / (1 + np.exp(-odds))) < 2e-3


def test_only_the_sample_meets_in_one_task(spark):
    """An exchange stands between the scan of all documents and the descent."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = subword.training_rows(docs, labels, "quality", subword.SubwordParams(), F.lit(True)).repartition(1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" in plan and "Coalesce" not in plan
