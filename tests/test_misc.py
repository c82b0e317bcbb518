"""Calendar, map-reduce, envelopes, reliability, stores, ingest gate, entry contract."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearline.functions import calendar as CAL
from nearline.functions import envelopes as EN
from nearline.operators import mapreduce as MR
from nearline.operators import minhash as M
from nearline.session import ensure_checkpoint_dir
from nearline.sources import store as S
from nearline.streaming import ingest as IG

from .conftest import SF001


def test_months(spark):
    df = spark.createDataFrame([("january",), (" JAN ",), ("jan",), ("foo",), ("Janxyz",), ("",)], "m string")
    assert [r[0] for r in df.select(CAL.normalise_month(F.col("m"))).collect()] == ["Jan", "Jan", "Jan", "foo", "Jan", ""]
    d = spark.createDataFrame([(2025, "Jul", -7), (2025, "Dec", 2), (2026, "Feb", -2)], "y int, m string, d int")
    got = [tuple(r) for r in d.select(*CAL.add_months(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert got == [(2024, "Dec"), (2026, "Feb"), (2025, "Dec")]


def test_map_reduce(spark):
    df = spark.range(1, 1000).withColumnRenamed("id", "x")
    parts = MR.chunk_partials(df.withColumn("pos", F.col("x") - 1), "pos", F.col("x"), 100)
    assert parts.count() == 10
    assert parts.agg(F.sum("partial")).first()[0] == 332833500
    assert MR.sum_of_squares(df, F.col("x")).first().total == 332833500
    five = spark.range(1, 6).withColumnRenamed("id", "x")
    out = MR.chain(five, lambda d: d.withColumn("x", F.col("x") * 2), lambda d: d.agg(F.avg("x").alias("m")),
                   lambda d: d.withColumn("score", F.col("m") / 10)).first()
    assert (out.m, out.score) == (6.0, 0.6)


def test_envelopes(spark):
    import base64
    b = base64.b64encode(b'{"a": 1}').decode()
    df = spark.createDataFrame([(f" {b}\n",), (f'{{"b64": "{b}"}}',), (f'{{"body_b64": "{b}"}}',), ('{"x": 1}',),
                                ("!!notb64",)], "raw string")
    got = [tuple(r) for r in df.select(EN.unwrap(F.col("raw")).alias("u")).select("u.status_code", EN.as_text(F.col("u.body"))).collect()]
    assert got == [(200, '{"a": 1}'), (200, '{"a": 1}'), (200, '{"a": 1}'), (400, None), (400, None)]
    t = spark.createDataFrame([("log\n{\"a\": 1}\n\nnoise",), ("5",), ("no json",)], "t string")
    assert [r[0] for r in t.select(EN.last_json_line(F.col("t"))).collect()] == ['{"a": 1}', "5", None]


def test_store_idempotent_upsert_and_lifecycle(spark):
    root = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    st = S.TableStore(spark, root, S.LOOKUP_SCHEMA, "id", "first_wins", ["timestamp"])
    assert st.create_if_absent(distance="cosine") and not st.create_if_absent(distance="cosine")
    rows = spark.createDataFrame([("a", "a", 1.0, "x"), ("a", "b", 0.9, "y"), ("c", "c", 1.0, "z")],
                                 "id string, closest_log_id string, similarity double, location string") \
        .withColumn("timestamp", F.current_timestamp())
    st.insert_if_absent(rows, 0)
    first = sorted(tuple(r) for r in st.current().select("id", "closest_log_id").collect())
    st.insert_if_absent(rows, 0)
    st.insert_if_absent(rows, 1)
    assert sorted(tuple(r) for r in st.current().select("id", "closest_log_id").collect()) == first
    assert len(first) == 2
    st.truncate()
    assert st.current().count() == 0 and st.exists()
    assert st.drop_if_present() and not st.exists()


def test_ingest_gate_fixture(spark, logs):
    root = f"{ensure_checkpoint_dir(spark)}/g-{uuid.uuid4().hex}"
    pts, look = S.point_store(spark, root), S.lookup_store(spark, root)
    cfg = IG.GateConfig(M.MinHashParams(5, 128, 32, 123, stop_short_lines=5), 0.8, "cosine")
    batch = logs.select("text", "pod_name", "severity", F.to_timestamp("timestamp").alias("ts"))
    d0 = IG.ingest(batch, pts, look, cfg, 0)
    assert {r.decision for r in d0.collect()} == {"new"}          # empty store: all new, twins included
    d1 = IG.ingest(batch, pts, look, cfg, 1)
    assert {r.decision for r in d1.collect()} == {"duplicate"}
    n_points, n_lookup = pts.current().count(), look.current().count()
    IG.ingest(batch, pts, look, cfg, 1)                              # replay
    assert (pts.current().count(), look.current().count()) == (n_points, n_lookup) == (5, 5)
    edges = IG.sync_edges(pts)
    # a point sharing no band with any other point has no candidate, hence no edge
    assert 1 <= edges.count() <= 5 and edges.where("src = dst").count() == 0


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["doc_id", "cluster_id", "similarity"]
    n_docs = spark.read.parquet(f"{SF001}/documents.parquet").count()
    assert df.count() == n_docs
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 70


def test_stream_gate_equals_batch_gate(spark, logs):
    """foreachBatch over two parquet files gives the same stores as two batch calls."""
    base = f"{ensure_checkpoint_dir(spark)}/s-{uuid.uuid4().hex}"
    src = logs.select("n", "text", "pod_name", "severity", F.to_timestamp("timestamp").alias("ts"))
    cfg = IG.GateConfig(M.MinHashParams(5, 64, 16, 7, profile="basic"), 0.8, "jaccard")

    bp, bl = S.point_store(spark, f"{base}/batch"), S.lookup_store(spark, f"{base}/batch")
    IG.ingest(src.where("n <= 2").drop("n"), bp, bl, cfg, 0)
    IG.ingest(src.where("n > 2").drop("n"), bp, bl, cfg, 1)

    # stream: the second file arrives after the first run has finished
    stream_dir = f"{base}/stream_in"
    src.where("n <= 2").drop("n").coalesce(1).write.parquet(f"{stream_dir}/a")
    sp, sl = S.point_store(spark, f"{base}/stream"), S.lookup_store(spark, f"{base}/stream")
    schema = src.drop("n").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{stream_dir}/*")
    q = IG.stream_ingest(stream, sp, sl, cfg, f"{base}/ckpt")
    q.awaitTermination()
    src.where("n > 2").drop("n").coalesce(1).write.parquet(f"{stream_dir}/b")
    q = IG.stream_ingest(stream, sp, sl, cfg, f"{base}/ckpt")
    q.awaitTermination()

    def rows(st):
        return sorted(tuple(r) for r in st.current().select("id", "closest_log_id", F.round("similarity", 6)).collect())
    assert rows(sl) == rows(bl) and len(rows(bl)) == 5
    assert sorted(r.id for r in sp.current().collect()) == sorted(r.id for r in bp.current().collect())


def test_gate_dedupe_within_batch(spark, logs):
    """Off (faithful): twins inside one batch are both stored; on: the later twin points at the first."""
    batch = logs.select("text", "pod_name", "severity", F.to_timestamp("timestamp").alias("ts"))
    out = {}
    for flag in (False, True):
        root = f"{ensure_checkpoint_dir(spark)}/w-{uuid.uuid4().hex}"
        pts, look = S.point_store(spark, root), S.lookup_store(spark, root)
        cfg = IG.GateConfig(M.MinHashParams(5, 64, 16, 3), 0.8, "jaccard", dedupe_within_batch=flag)
        d = IG.ingest(batch, pts, look, cfg, 0)
        out[flag] = (sorted(r.decision for r in d.collect()), pts.current().count())
    assert out[False] == (["new"] * 5, 5)
    # records 3 and 5 normalise to the same text: one of them becomes a duplicate of the other
    assert out[True] == (["duplicate"] + ["new"] * 4, 4)


def test_envelopes_of_any_bytes(spark):
    """Bytes that are no UTF-8 pass as bytes; a b64 that is no string is refused."""
    import base64
    raw = base64.b64encode(b"\xff\xfe\x00").decode()
    df = spark.createDataFrame([(raw,), ('{"b64": 1234}',), ('{"b64": "", "body_b64": "%s"}' % raw,)], "raw string")
    u = df.select(EN.unwrap(F.col("raw")).alias("u")).select("u.status_code", "u.body", EN.as_text(F.col("u.body"))).collect()
    assert [(r[0], bytes(r[1]) if r[1] else None, r[2]) for r in u] == [(200, b"\xff\xfe\x00", None), (400, None, None), (200, b"\xff\xfe\x00", None)]


def test_strict_records_fail(spark):
    from nearline.functions import records as R
    df = spark.createDataFrame([("a", ("p", "t", "s", "x"), None), (None, ("p", "t", "s", "x"), None)], R.RECORD_SCHEMA)
    assert R.require_valid(df.where("text is not null")).count() == 1
    with pytest.raises(Exception, match="missing text"):
        R.require_valid(df).count()


USERS = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.IntegerType())])


def _store(spark):
    return S.TableStore(spark, f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}", USERS, "id", "last_wins", ["v"])


def _rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), USERS)


def _view(st):
    return sorted((r.id, r.v) for r in st.current().collect())


def test_delete_survives_a_micro_batch(spark):
    st = _store(spark)
    st.upsert(_rows(spark, ("a", 1), ("b", 1)), 0, "stream-x")
    st.delete_where(F.col("id") == "a")
    st.upsert(_rows(spark, ("c", 1)), 1, "stream-x")
    assert _view(st) == [("b", 1), ("c", 1)]
    st.upsert(_rows(spark, ("d", 1)), 0, "stream-y")             # a restart on a new checkpoint
    assert _view(st) == [("b", 1), ("c", 1), ("d", 1)]
    st.update_where(F.col("id") == "d", {"v": F.lit(5)}, 0, "op")
    st.update_where(F.col("id") == "d", {"v": F.col("v") + 1}, 1, "op")
    st.update_where(F.col("id") == "d", {"v": F.col("v") + 1}, 1, "op")   # repeated: the same state before it
    assert _view(st) == [("b", 1), ("c", 1), ("d", 6)]


def test_empty_repeat_removes_the_rows(spark):
    st = _store(spark)
    st.upsert(_rows(spark, ("a", 1)), 0, "w")
    st.upsert(_rows(spark, ("a", 1)).limit(0), 0, "w")
    assert _view(st) == []


def test_store_faults_are_not_an_empty_store(spark):
    st = _store(spark)
    st.upsert(_rows(spark, ("a", 1)))
    other = S.TableStore(spark, st.root, T.StructType([T.StructField("id", T.ArrayType(T.IntegerType())), T.StructField("v", T.IntegerType())]), "id")
    with pytest.raises(Exception):
        other.log().collect()


def test_dedupe_points_at_stored_records(spark, logs):
    root = f"{ensure_checkpoint_dir(spark)}/w-{uuid.uuid4().hex}"
    pts, look = S.point_store(spark, root), S.lookup_store(spark, root)
    cfg = IG.GateConfig(M.MinHashParams(5, 64, 16, 3), 0.8, "jaccard", dedupe_within_batch=True)
    batch = logs.select("text", "pod_name", "severity", F.to_timestamp("timestamp").alias("ts"))
    IG.ingest(batch.where("pod_name <> 'pod-1'"), pts, look, cfg)
    IG.ingest(batch.withColumn("pod_name", F.concat("pod_name", F.lit("x"))), pts, look, cfg)
    stored = {r.id for r in pts.current().collect()}
    assert {r.closest_log_id for r in look.current().collect()} <= stored


def test_late_stream_rows_are_kept(spark, logs):
    """Files out of order in time: no row is lost."""
    base = f"{ensure_checkpoint_dir(spark)}/s-{uuid.uuid4().hex}"
    src = logs.select("n", "text", "pod_name", "severity", F.to_timestamp("timestamp").alias("ts"))
    src.where("n = 1").drop("n").coalesce(1).write.parquet(f"{base}/in/a")
    src.where("n > 1").drop("n").coalesce(1).write.parquet(f"{base}/in/b")
    pts, look = S.point_store(spark, base), S.lookup_store(spark, base)
    stream = spark.readStream.schema(src.drop("n").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    cfg = IG.GateConfig(M.MinHashParams(5, 64, 16, 7, profile="basic"), 0.8, "jaccard")
    IG.stream_ingest(stream, pts, look, cfg, f"{base}/ckpt", skip_seen=True).awaitTermination()
    assert look.current().count() == 5


def test_no_scratch_folder_off_local_masters(spark):
    from nearline.session import is_local
    assert is_local(spark)

    class Far:
        class sparkContext:  # noqa: N801
            master = "local-cluster[2,1,1024]"
    assert not is_local(Far)


def test_log_store(spark, logs):
    from nearline.sources.log_store import LogStore
    st = LogStore(spark, f"{ensure_checkpoint_dir(spark)}/ls-{uuid.uuid4().hex}", IG.GateConfig(M.MinHashParams(5, 64, 16, 3), 0.8, "jaccard"))
    assert st.create() and not st.create()
    batch = logs.select("text", "pod_name", "severity", F.to_timestamp("timestamp").alias("ts"))
    assert st.insert(batch).count() == 5
    top = st.search_text(batch.first()["text"], 2).collect()
    assert top[0].score == 1.0 and len(top) == 2
    assert {r.pod_name for r in st.search_text("anything", 5, {"key": "pod_name", "op": "equals", "value": "pod-2"}).collect()} == {"pod-2"}
    page, _ = st.scroll(batch_size=3)
    assert page.count() == 3 and st.near_occurrences([top[0].id]).count() == 1
    assert st.sync().count() >= 1 and st.points.current().where("sim_sync").count() >= 1
    st.clear()
    assert st.points.current().count() == 0 and not st.create()
    st.reset()
    assert st.points.exists() and st.lookup.exists()


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    """A table that Spark wrote is a folder; the stream takes all its part files."""
    from nearline.plans import q_store
    rows = [(i, f"request {'abcdefgh'[i]} failed {'xyzuvwst'[i] * 9} in module {'klmnopqr'[i] * 7}", "en", "a", 9) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(docs.inputFiles()) == 2
    ids = {r.id for r in docs.select(q_store.IG.log_id(F.col("text"), F.col("source"), F.col("lang")).alias("id")).collect()}
    assert {r.id for r in q_store.q_stream_ingest(spark, str(tmp_path)).collect()} == ids


def test_gate_rows_stay_where_they_are(spark, tmp_path):
    """Whole rows are neither shuffled nor sorted to be decided: equal signatures
    have one match, which is joined by their key; repeated ids keep all rows."""
    text = "ERROR 2026-01-13T12:00:01Z user_id=123e4567-e89b-12d3-a456-426614174000 request took {}ms"
    rows = [(text.format(k % 7), f"pod-{k}", "ERROR", None) for k in range(60)]
    logs = spark.createDataFrame(rows + rows[:5], "text string, pod_name string, severity string, ts timestamp")
    cfg = IG.GateConfig(M.MinHashParams(5, 64, 16, 42, profile="basic", skip=("num",)), 0.8, "jaccard")
    pts, look = S.point_store(spark, str(tmp_path / "g")), S.lookup_store(spark, str(tmp_path / "g"))
    IG.ingest(logs.where("pod_name <> 'pod-59'"), pts, look, cfg, 0)
    dec = IG.ingest(logs, pts, look, cfg, 1)
    assert dec.columns == ["id", "signature", "band_keys", "text_payload", "pod_name", "severity", "ts", "match_id", "similarity",
                           "decision", "closest_log_id", "lookup_sim"]
    plan = dec._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan
    got = dec.collect()
    assert len(got) == 65 and {r.decision for r in got} == {"duplicate"}
    first = {}
    for r in pts.current().collect():
        first[tuple(r.signature)] = min(first.get(tuple(r.signature), r.id), r.id)
    assert all(r.closest_log_id == first[tuple(r.signature)] and r.similarity == 1.0 for r in got)


def test_seen_records_are_not_embedded(spark, tmp_path):
    """Records seen before are left out before the masking, not after it."""
    logs = spark.createDataFrame([(f"took {k} ms of time", "p", "INFO", None) for k in range(6)], "text string, pod_name string, severity string, ts timestamp")
    cfg = IG.GateConfig(M.MinHashParams(5, 64, 16, 42, profile="basic"), 0.8, "jaccard")
    ids = IG.embed_logs(logs, cfg).select("id").limit(4)
    rows = IG.embed_logs(logs, cfg, ids)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("LeftAnti") and rows.count() == 2


def test_nearest_signatures_of_keys_alone(spark):
    from nearline.streaming import neighbours
    rows = [(f"i{k:02}", f"k{k % 3}", [k % 3, 1], [7, 8 + k % 3]) for k in range(9)]
    members = spark.createDataFrame(rows, "id string, key string, signature array<bigint>, bands array<bigint>")
    some = members.where("id >= 'i02'").select("id", "key")
    for limit in ("10MB", "-1"):
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = sorted((r.key, r.id, r.second, r.signature, r.bands) for r in neighbours._signatures(some, members).collect())
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert got == [("k0", "i03", "i06", [0, 1], [7, 8]), ("k1", "i04", "i07", [1, 1], [7, 9]), ("k2", "i02", "i05", [2, 1], [7, 10])]
