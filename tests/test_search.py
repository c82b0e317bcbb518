"""Searches by blocks and nearest other points, against brute force."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearline.operators import tiles
from nearline.operators import vectors as V
from nearline.session import ensure_checkpoint_dir

SCHEMA = "id string, v array<double>, label int"


def points(n, dim, seed):
    rng = random.Random(seed)
    rows = [(f"p{i}", [round(rng.gauss(0, 1), 1) for _ in range(dim)], rng.choice([0, 0, 0, 1, None])) for i in range(n)]
    return rows + [("twin", rows[0][1], 0), ("none", None, 0), ("zero", [0.0] * dim, 1)]


def cost(metric, a, b):
    a, b = np.array(a), np.array(b)
    if metric == "euclidean":
        return round(float(np.sqrt(((a - b) ** 2).sum())), 6)
    if metric == "dot":
        return round(float(-(a @ b)), 6)
    n = np.sqrt((a @ a)) * np.sqrt((b @ b))
    return round(float(-(a @ b) / n) if n else -0.0, 6)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_blocks_equal_brute_force(spark, metric):
    rows = points(60, 5, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = spark.createDataFrame([(f"p{i}", rows[i][1], rows[i][2], [None, 0, 1][i % 3]) for i in range(0, 60, 4)] + [("q", None, 0, None)], "qid string, w array<double>, label int, f int")
    conds = [F.col("label") == 1, F.col("label").isNull()]
    allow = [lambda r: r[2] == 1, lambda r: r[2] is None]
    for name, kw, ok in [("plain", {}, lambda q, r: True),
                         ("not self", {"not_self": True}, lambda q, r: q.qid != r[0]),
                         ("same", {"same": ("label", "label")}, lambda q, r: q.label is not None and q.label == r[2]),
                         ("filters", {"filters": conds, "filter_col": "f"}, lambda q, r: q.f is None or allow[q.f](r))]:
        want = {}
        for q in asked.collect():
            if q.w is not None:
                found = sorted((cost(metric, q.w, r[1]), r[0]) for r in rows if r[1] is not None and ok(q, r))[:4]
                want.update({(q.qid, i + 1): (r, c) for i, (c, r) in enumerate(found)})
        for sizes in ({"point_rows": 7, "query_rows": 3}, {}):
            got = V.search_blocks(df, "id", "v", asked, "qid", "w", 4, metric, **kw, **sizes).collect()
            got = {(r.qid, r["rank"]): (r.id, round(r.score if metric == "euclidean" else -r.score, 6)) for r in got}
            assert got.keys() == want.keys(), name
            assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-5 for x in want), name


def test_empty_tables(spark):
    df = spark.createDataFrame(points(5, 3, 1), SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    assert V.search_blocks(none, "id", "v", df, "id", "v", 2).collect() == []
    assert V.search_blocks(df, "id", "v", none, "id", "v", 2).collect() == []
    longs = spark.createDataFrame([], "id long, v array<double>")
    assert V.nearest_others(longs, "id", "v").collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    assert V.nearest_others(one, "id", "v").collect() == []


def truth(ids, m, metric="cosine"):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True) if metric == "cosine" else m
    best = np.empty(len(m))
    for a in range(0, len(m), 500):
        s = unit[a:a + 500] @ unit.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -9
        best[a:a + 500] = s.max(axis=1)
    return dict(zip(ids, best))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_nearest_other_point(spark, sf):
    emb = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = emb.collect()
    best = truth([r.vec_id for r in rows], np.array([r.embedding for r in rows], float))
    got = {r.vec_id: r.score for r in V.nearest_others(emb, "vec_id", "embedding").collect()}
    assert got.keys() == best.keys()                              # no row without an answer
    assert sum(got[i] >= best[i] - 1e-6 for i in best) >= 0.9 * len(best)


def test_points_with_structure_use_the_index(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    m = np.concatenate([np.repeat(centres, 50, axis=0) + 0.15 * rng.normal(size=(3000, 24)), 40 * rng.normal(size=(3, 24)), centres[:1]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")
    params = V.IndexParams(sample=1500, asks=150)
    c = V.fit_lists(df, "cosine", params)
    assert 2 * V.probes_needed(df, c, "cosine", params) < len(c)   # far fewer lists than all
    monkeypatch.setattr(V, "best_partners", None)                  # the exact route would fail
    best = truth(range(len(m)), m)
    got = {r.id: r.score for r in V.nearest_others(df, "id", "v", params=params, chunk=70).collect()}
    assert got.keys() == best.keys()
    assert sum(got[i] >= best[i] - 1e-6 for i in best) >= 0.9 * len(best)


def test_tiles_of_any_size_give_the_same(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(90, 6))
    df = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(m)], "id long, v array<double>, g int")
    best = truth(range(90), m)
    both = df.select("id", "v", F.lit(0).alias("g"))
    for chunk in (7, 1000):
        near = tiles.best_partners(both, "g", "id", "v", V.cost_blocks("cosine"), chunk).collect()
        assert len(near) == 90 and all(abs(-r.cost - best[r.id]) < 1e-8 for r in near)
        lists = tiles.best_of_lists(both.select("g", "id", "v"), both.select("g", "id", "v"), V.cost_blocks("cosine"), chunk).collect()
        assert sorted(map(tuple, lists)) == sorted((r.id, r.partner, r.cost) for r in near)


def test_batch_of_texts_equals_single_searches(spark, logs):
    from nearline.operators import minhash as M
    from nearline.sources.log_store import LogStore
    from nearline.streaming import ingest as IG
    for metric in ("jaccard", "cosine"):
        st = LogStore(spark, f"{ensure_checkpoint_dir(spark)}/sb-{uuid.uuid4().hex}", IG.GateConfig(M.MinHashParams(5, 64, 16, 3), 0.8, metric))
        st.create()
        st.insert(logs.select("text", "pod_name", "severity", F.to_timestamp("timestamp").alias("ts")))
        texts = [r.text for r in logs.orderBy("n").collect()] + ["something else", ""]
        spec = [{"key": "pod_name", "op": "equals", "value": "pod-2"}]
        asked = spark.createDataFrame([(i, t, i % 2 if i % 2 == 0 else None) for i, t in enumerate(texts)], "qid int, text string, filter int")
        got = {}
        for r in st.search_batch(asked, 3, [spec]).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.id, round(r.score, 6)))
        for i, t in enumerate(texts):
            want = [(r.id, round(r.score, 6)) for r in st.search_text(t, 3, spec if i % 2 == 0 else None).collect()]
            assert got[i] == want


def test_two_chunks_are_compared_once(spark):
    """A tile of two chunks computes their block of costs once, for the rows of both."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(120, 4)), 1)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>").withColumn("g", F.lit(1))
    cells = spark.sparkContext.accumulator(0)
    plain = V.cost_blocks("euclidean")

    def costs(a, b):
        cells.add(len(a) * len(b))
        return plain(a, b)

    got = {r.id: (r.partner, round(r.cost, 6)) for r in tiles.best_partners(df, "g", "id", "v", costs, 30).collect()}
    d = np.round(np.sqrt(((v[:, None] - v[None, :]) ** 2).sum(-1)), 9)
    np.fill_diagonal(d, np.inf)
    assert got == {i: (int(d[i].argmin()), round(float(d[i].min()), 6)) for i in range(120)}
    assert cells.value <= 120 * 120
