"""Embedders, SQL functions, exact medians, ordered listing."""

import hashlib
import random
import statistics
import uuid

import pytest
from pyspark.sql import functions as F

from nearline.operators import embedders as E
from nearline.operators import minhash as M
from nearline.operators.selection import exact_median
from nearline.session import ensure_checkpoint_dir
from nearline.sources.log_store import LogStore
from nearline.streaming import ingest as IG

EMBEDDERS = [E.MinHashEmbedder(M.MinHashParams(5, 64, 16, 3), "jaccard"), E.WordCountEmbedder(), E.WordCountEmbedder(64, 8, 3, 5, "dot")]


@pytest.mark.parametrize("embedder", EMBEDDERS, ids=["minhash", "words", "words-dot"])
def test_any_embedder_passes_the_gate(spark, logs, embedder):
    st = LogStore(spark, f"{ensure_checkpoint_dir(spark)}/em-{uuid.uuid4().hex}", IG.GateConfig(embedder=embedder, threshold=0.8))
    st.create()
    assert st.points.properties()["dim"] == embedder.size and st.points.properties()["distance"] == embedder.distance
    batch = logs.select("text", "pod_name", "severity", F.to_timestamp("timestamp").alias("ts"))
    assert {r.decision for r in st.insert(batch).collect()} == {"new"}
    assert {r.decision for r in st.insert(batch.withColumn("pod_name", F.lit("other"))).collect()} == {"duplicate"}
    row = spark.createDataFrame([("a text of seven words in all",), (None,)], "text string")
    out = embedder.embeds(row.withColumn("text", F.coalesce("text", F.lit("")))).collect()
    assert all(len(r.signature) == embedder.size and r.band_keys for r in out)
    same = row.limit(1).select(embedder.embed(F.col("text")).alias("v")).first()["v"]
    assert list(same) == list(out[0].signature)
    top = st.search_text(batch.first()["text"], 1).first()
    assert top.score >= 0.999 and st.sync().count() >= 1 and st.points.current().where("NOT sim_sync").count() == 0


def test_embedders_refuse_what_they_cannot_do():
    for bad in (lambda: E.WordCountEmbedder(0), lambda: E.WordCountEmbedder(8, distance="hamming"),
                lambda: E.MinHashEmbedder(M.MinHashParams(hash="blake2b")), lambda: IG.similarity_blocks("euclidean")):
        with pytest.raises(ValueError):
            bad()


def test_sql_functions(spark):
    p = M.MinHashParams(5, 16, 8, 42, profile="basic", normalize=False, lowercase=False, collapse_whitespace=False)
    for metric in ("jaccard", "cosine", "dot"):
        e = E.MinHashEmbedder(p, metric)
        E.register_functions(spark, e, "t")
        df = spark.createDataFrame([("the quick brown fox", "the quick brown cat"), ("abc", "")], "a string, b string")
        by_sql = [r[0] for r in spark.sql("SELECT t_compare(t_signature(t_grams(a)), t_signature(t_grams(b))) FROM {df}", df=df).collect()]
        by_columns = [r[0] for r in df.select(e.compare(e.embed(F.col("a")), e.embed(F.col("b")))).collect()]
        assert by_sql == pytest.approx(by_columns)
    assert [tuple(r) for r in spark.sql("SELECT * FROM t_shingles('a b c d', 3)").collect()] == [("a b c", 0), ("b c d", 1)]
    # All texts of an id in one call, each run once: nothing to tell apart by a shuffle.
    once = spark.sql("SELECT * FROM t_shingles(array('a b a b', NULL, 'b a c'), 2, true)").collect()
    assert [tuple(r) for r in once] == [("a b", 0), ("b a", 1), ("a c", 1)]


def test_sql_signatures_are_made_once(spark):
    """Both sides of the join read one table of signatures, and grams stay on the tasks' Python side."""
    from nearline.plans.q_minhash import P_SQL, q_sql_functions
    plan = q_sql_functions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [" not in plan and "regexp_extract_all" not in plan
    E.register_functions(spark, E.MinHashEmbedder(P_SQL, "jaccard"), "u")
    df = spark.createDataFrame([(1, "some words, some words"), (2, "abc"), (3, None), (4, "\u00e9\u4e00 caf\u00e9 \U0001f600!")], "id int, t string")
    made = spark.sql("SELECT id, t, u_grams(t) AS g, u_signature(u_grams(t)) AS s FROM {df}", df=df)
    assert spark.sql("SELECT u_signature(u_grams(t)) FROM {df}", df=df)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in made.collect():
        grams = {r.t[k:k + 5] for k in range(len(r.t or "") - 4)} if r.t else set()
        want = {int.from_bytes(hashlib.md5(g.encode()).digest()[:4], "big") for g in grams}
        assert set(r.g) == want and len(r.g) == len(want) and len(r.s) == 16
    short = E.MinHashEmbedder(M.MinHashParams(5, 16, 8, 42, stop_short_lines=9, normalize=False, lowercase=False, collapse_whitespace=False), "jaccard")
    E.register_functions(spark, short, "v")
    assert [len(r[0]) for r in spark.sql("SELECT v_grams(t) FROM (VALUES ('12345678'), ('123456789'), (NULL)) AS x(t)").collect()] == [0, 5, 0]


def test_exact_median(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.gauss(0, 1e3), float(rng.randrange(30)), 7.0])) for _ in range(30000)]
    rows += [("even", float(i)) for i in range(1000)] + [("odd", float(i * i)) for i in range(333)] + [(None, 2.5), (None, 3.5), ("null", None), ("one", -4.0)]
    rows += [("ties", 1.0)] * 500 + [("ties", 2.0)] * 500 + [("ties", None)] * 9 + [("wide", 10.0 ** rng.randrange(-300, 300)) for _ in range(3001)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {}
    for g, v in rows:
        want.setdefault(g, []).append(v)
    want = {g: [x for x in v if x is not None] for g, v in want.items()}
    for bins, keep in ((64, 5000), (8, 8)):
        got = {r.g: (r["median"], r.n_values) for r in exact_median(df if keep > 8 else df.where("coalesce(g, '') NOT IN ('hot', 'wide')"), ["g"], "v", bins, keep).collect()}
        assert all(got[g] == (pytest.approx(statistics.median(want[g])) if want[g] else None, len(want[g])) for g in got)
        assert len(got) == (8 if keep > 8 else 6)


def test_history_is_in_order(spark):
    import __spark_entry__ as entry
    rows = [(r.conv_id, r.turn) for r in entry.queries()["conversation_history"](spark, "/root/testdata/sf0.001").collect()]
    assert rows == sorted(rows) and len(rows) > 20
