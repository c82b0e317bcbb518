"""Store, lookup and ingest-gate queries.

Stores live in fresh folders under the session's checkpoint directory (the
shared folder on a cluster); each query run creates its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import filters as FL
from ..operators import minhash as M
from ..session import ensure_checkpoint_dir
from ..sources import store as S
from ..sources.points import event_points
from ..sources.tables import LOG_LINES_SQL, log_lines, table
from ..streaming import ingest as IG
from .registry import register


def _root(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _halves(df, ts: str = "ts"):
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    mid = df.select((F.min(us) + F.floor((F.max(us) - F.min(us)) / 2)).alias("m")).scalar()
    return df.where(us < mid), df.where(us >= mid)


MID_SQL = "(SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 FROM events)"

USER_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("event_id", T.LongType()),
                            T.StructField("event_type", T.StringType()), T.StructField("ts", T.TimestampType())])


def _user_rows(ev):
    return ev.select(F.col("user_id").cast("string").alias("id"), "event_id", "event_type",
                     F.col("ts").cast("timestamp").alias("ts"))


@register("upsert_latest", "A5 H3", """
SELECT id, event_id, event_type FROM (
  SELECT user_id::VARCHAR AS id, event_id, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_upsert_latest(spark, sf):
    st = S.TableStore(spark, _root(spark, "users"), USER_SCHEMA, "id", "last_wins", ["ts", "event_id"])
    first, second = _halves(table(spark, sf, "events"))
    st.upsert(_user_rows(first), 0)
    st.upsert(_user_rows(second), 1)
    st.upsert(_user_rows(second), 1)          # replay: no change
    return st.current().select("id", "event_id", "event_type")


@register("insert_if_absent", "A7 F2", f"""
WITH b0 AS (SELECT * FROM events WHERE epoch_us(ts) >= {MID_SQL}),
f0 AS (SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rn FROM b0) WHERE rn = 1),
f1 AS (SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rn FROM events) WHERE rn = 1)
SELECT user_id::VARCHAR AS id, event_id, event_type FROM f0
UNION ALL
SELECT user_id::VARCHAR AS id, event_id, event_type FROM f1 WHERE user_id NOT IN (SELECT user_id FROM f0)""")
def q_insert_if_absent(spark, sf):
    st = S.TableStore(spark, _root(spark, "first"), USER_SCHEMA, "id", "first_wins", ["ts", "event_id"])
    ev = table(spark, sf, "events")
    _first, second = _halves(ev)
    st.insert_if_absent(_user_rows(second), 0)
    st.insert_if_absent(_user_rows(ev), 1)
    st.insert_if_absent(_user_rows(ev), 1)    # replay: no change
    return st.current().select("id", "event_id", "event_type")


@register("scroll_page", "A11 H5 E2", """
SELECT event_id AS id, upper(event_type) AS severity FROM events
WHERE upper(event_type) IN ('ERROR', 'CLICK') AND event_id > 5000 ORDER BY event_id LIMIT 10""")
def q_scroll_page(spark, sf):
    pts = event_points(spark, sf)
    cond = FL.compile_specs([{"key": "severity", "op": "in", "value": ["ERROR", "CLICK"]}], pts)
    page, _next = S.scroll(pts.select("id", "severity"), "id", cond, batch_size=10, offset=5000)
    return page


NOTE_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("severity", T.StringType()),
                            T.StructField("pod_name", T.StringType()), T.StructField("note", T.StringType())])


def _note_rows(spark, sf):
    pts = event_points(spark, sf)
    return pts.select("id", "severity", "pod_name",
                      F.try_variant_get("payload", "$.note", "string").alias("note"))


@register("delete_where", "A12 E15 E8", f"""
SELECT id, severity FROM (SELECT event_id AS id, upper(event_type) AS severity,
  CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE 'v=' || value::VARCHAR END AS note FROM events)
WHERE NOT (severity = 'PURCHASE' OR note IS NULL)""")
def q_delete_where(spark, sf):
    st = S.TableStore(spark, _root(spark, "notes"), NOTE_SCHEMA, "id", "last_wins")
    rows = _note_rows(spark, sf)
    st.upsert(rows, 0)
    spec = {"logic": "or", "clauses": [{"key": "severity", "op": "equals", "value": "PURCHASE"},
                                       {"key": "note", "op": "is_null"}]}
    cond = FL.compile_specs([spec], rows)
    st.delete_where(cond, 1)
    return st.current().select("id", "severity")


MAP_SCHEMA = T.StructType([T.StructField("id", T.LongType()),
                           T.StructField("payload", T.MapType(T.StringType(), T.StringType()))])


@register("update_payload_where", "A13 J10", """
WITH p AS (SELECT event_id AS id, upper(event_type) AS severity, json_extract_string(props, '$.k') AS k,
                  'pod-' || (user_id % 5)::VARCHAR AS pod FROM events)
SELECT id, 'severity' AS key, severity AS value FROM p
UNION ALL SELECT id, 'pod', pod FROM p
UNION ALL SELECT id, 'k', CASE WHEN severity = 'ERROR' THEN '0' ELSE k END FROM p
UNION ALL SELECT id, 'reviewed', 'true' FROM p WHERE severity = 'ERROR'""")
def q_update_payload_where(spark, sf):
    from ..functions.envelopes import merge_payload
    pts = event_points(spark, sf)
    rows = pts.select("id", F.create_map(
        F.lit("severity"), F.col("severity"), F.lit("pod"), F.col("pod_name"),
        F.lit("k"), F.try_variant_get("payload", "$.k", "string")).alias("payload"))
    st = S.TableStore(spark, _root(spark, "payloads"), MAP_SCHEMA, "id", "last_wins")
    st.upsert(rows, 0)
    new = F.create_map(F.lit("k"), F.lit("0"), F.lit("reviewed"), F.lit("true"))
    st.update_where(F.element_at("payload", F.lit("severity")) == "ERROR",
                    {"payload": merge_payload(F.col("payload"), new)}, 1)
    return st.current().select("id", F.explode("payload").alias("key", "value"))


@register("parameterised_sql", "A10", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus = 'F' GROUP BY o_orderpriority""")
def q_parameterised_sql(spark, sf):
    return spark.sql(
        "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} "
        "WHERE o_orderdate >= :start AND o_orderstatus = :status GROUP BY o_orderpriority",
        args={"start": "1996-01-01 00:00:00", "status": "F"}, orders=table(spark, sf, "orders"))


@register("store_lifecycle", "A3 A4 A6 A8 A9", """
SELECT 'created' AS step, 1::BIGINT AS value UNION ALL SELECT 'created_again', 0
UNION ALL SELECT 'rows_before_clear', count(*) FROM events UNION ALL SELECT 'rows_after_clear', 0
UNION ALL SELECT 'dropped', 1 UNION ALL SELECT 'recreated', 1""")
def q_store_lifecycle(spark, sf):
    root = _root(spark, "life")
    pts, look = S.point_store(spark, root), S.lookup_store(spark, root)
    created = [pts.create_if_absent(dim=128, distance="cosine"), look.create_if_absent()]
    again = [pts.create_if_absent(dim=128, distance="cosine"), look.create_if_absent()]
    ev = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"),
                                           F.col("event_id").cast("string").alias("closest_log_id"),
                                           F.lit(1.0).alias("similarity"), F.col("ts").cast("timestamp").alias("timestamp"),
                                           F.lit("pod").alias("location"))
    look.insert_if_absent(ev, 0)
    n_before = look.current().count()
    look.truncate()                                     # A8 clear
    n_after = look.current().count()
    dropped = pts.drop_if_present()                     # A4 / A9 clear
    recreated = pts.create_if_absent(dim=128, distance="cosine")  # A9 reset
    return spark.createDataFrame(
        [("created", int(all(created))), ("created_again", int(any(again))), ("rows_before_clear", n_before),
         ("rows_after_clear", n_after), ("dropped", int(dropped)), ("recreated", int(recreated))],
        "step string, value long")


# The registered gate scores with the share of equal signature slots (the
# estimated Jaccard); raw-signature cosine, the faithful default of
# GateConfig, rates nearly every pair of log lines above 0.8.
GATE = IG.GateConfig(M.MinHashParams(5, 128, 32, 123, profile="full", skip=("long_token",)), 0.8, "jaccard")


def _gate_run(spark, sf):
    logs = log_lines(spark, sf)
    first, second = _halves(logs)
    root = _root(spark, "gate")
    pts, look = S.point_store(spark, root), S.lookup_store(spark, root)
    IG.ingest(first, pts, look, GATE, 0)                 # K2: empty store, everything new
    dec = IG.ingest(second, pts, look, GATE, 1)
    return dec, pts, look


LOG_ROWS_SQL = f"""logs AS ({LOG_LINES_SQL}),
mid AS (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 AS m FROM logs),
lg AS (SELECT md5(text || '-' || json_object('pod_name', pod_name, 'severity', severity)::VARCHAR) AS id, text,
              epoch_us(ts) < (SELECT m FROM mid) AS first FROM logs)"""


def _gate_sql(rows: str = LOG_ROWS_SQL, cfg: IG.GateConfig = GATE) -> str:
    """The gate from its definition: the best of all stored points that share a band."""
    p = cfg.params
    src = "(SELECT DISTINCT id, text FROM lg)"
    sig = M.signature_sql(src, "id", "text", p)
    bands = M.band_rows_sql("SELECT * FROM sig", "id", p)
    eq = (f"list_sum(list_transform(range(1, {p.num_hashes} + 1), lambda i: (a.signature[i] = b.signature[i])::INTEGER))"
          f" / {p.num_hashes}")
    return f"""WITH {rows},
sig AS ({sig}),
bands AS ({bands}),
keys AS (SELECT id, dense_rank() OVER (ORDER BY signature) AS k FROM sig),
stored AS (SELECT DISTINCT id FROM lg WHERE first),
incoming AS (SELECT id FROM lg WHERE NOT first),
news AS (SELECT k, min(id) AS any_id FROM (SELECT DISTINCT id FROM incoming) JOIN keys USING (id) GROUP BY k),
olds AS (SELECT k, min(id) AS match_id FROM stored JOIN keys USING (id) GROUP BY k),
cand AS (SELECT DISTINCT n.k, n.any_id, o.match_id FROM news n JOIN bands x ON x.id = n.any_id JOIN bands y ON y.band_key = x.band_key JOIN olds o ON o.match_id = y.id),
scored AS (SELECT c.k, c.match_id, {eq} AS similarity FROM cand c JOIN sig a ON a.id = c.any_id JOIN sig b ON b.id = c.match_id),
top AS (SELECT k, match_id, similarity FROM (
          SELECT *, row_number() OVER (PARTITION BY k ORDER BY similarity DESC, match_id) AS rn FROM scored) WHERE rn = 1),
best AS (SELECT i.id, match_id, similarity FROM (SELECT DISTINCT id FROM incoming) i JOIN keys USING (id) JOIN top USING (k)),
dec AS (SELECT i.id, coalesce(b.similarity >= {cfg.threshold}, false) AS dup, b.match_id, b.similarity
        FROM incoming i LEFT JOIN best b USING (id))"""


@register("ingest_gate", "K1 K2 F1 B21 A5 A7", lambda: _gate_sql() + """
SELECT id, CASE WHEN dup THEN 'duplicate' ELSE 'new' END AS decision,
       CASE WHEN dup THEN match_id ELSE id END AS closest_log_id,
       round(CASE WHEN dup THEN similarity ELSE 1.0 END, 6) AS similarity FROM dec""")
def q_ingest_gate(spark, sf):
    dec, _p, _l = _gate_run(spark, sf)
    return dec.select("id", "decision", "closest_log_id", F.round("lookup_sim", 6).alias("similarity"))


@register("ingest_summary", "G11", lambda: _gate_sql() + """
SELECT CASE WHEN dup THEN 'duplicate' ELSE 'new' END AS decision, count(*) AS n FROM dec GROUP BY 1""")
def q_ingest_summary(spark, sf):
    dec, _p, _l = _gate_run(spark, sf)
    return IG.summary(dec)


@register("occurrence_groups", "F6", lambda: _gate_sql() + """,
lk AS (SELECT id, id AS closest_log_id FROM stored
       UNION ALL SELECT id, CASE WHEN dup THEN match_id ELSE id END FROM dec)
SELECT closest_log_id, count(*) AS occurrences FROM lk GROUP BY 1""")
def q_occurrence_groups(spark, sf):
    _dec, _p, look = _gate_run(spark, sf)
    return S.occurrences(look.current())


@register("near_occurrences", "F5", lambda: _gate_sql() + """
SELECT d.id, CASE WHEN d.dup THEN d.match_id ELSE d.id END AS closest_log_id,
       round(CASE WHEN d.dup THEN d.similarity ELSE 1.0 END, 6) AS similarity
FROM dec d""")
def q_near_occurrences(spark, sf):
    dec, _p, look = _gate_run(spark, sf)
    wanted = dec.select("id")                      # every log of the second batch, as a semi join
    out = S.near_occurrences(look.current(), wanted)
    return out.select("id", "closest_log_id", F.round("similarity", 6).alias("similarity"))


def _sync_sql() -> str:
    """From the definition: of all stored points, the nearest other one that shares a band."""
    n = GATE.params.num_hashes
    eq = f"list_sum(list_transform(range(1, {n} + 1), lambda i: (a.signature[i] = b.signature[i])::INTEGER)) / {n}"
    return _gate_sql() + f""",
pts AS (SELECT id FROM stored UNION SELECT id FROM dec WHERE NOT dup),
by_key AS (SELECT k, min(id) AS first FROM pts JOIN keys USING (id) GROUP BY k),
seconds AS (SELECT k, min(id) AS second FROM pts JOIN keys USING (id) JOIN by_key USING (k) WHERE id <> first GROUP BY k),
both_ AS (SELECT DISTINCT p.k, p.first AS x, q.first AS y FROM by_key p JOIN bands u ON u.id = p.first JOIN bands v ON v.band_key = u.band_key
          JOIN by_key q ON q.first = v.id AND q.k <> p.k),
rated AS (SELECT z.k, z.y, {eq} AS sim FROM both_ z JOIN sig a ON a.id = z.x JOIN sig b ON b.id = z.y),
other AS (SELECT id AS src, y AS dst, sim FROM pts JOIN keys USING (id) JOIN rated USING (k)
          UNION ALL SELECT id, first, 1.0 FROM pts JOIN keys USING (id) JOIN by_key USING (k) WHERE id <> first
          UNION ALL SELECT first, second, 1.0 FROM by_key JOIN seconds USING (k))
SELECT src, dst, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rn FROM other) WHERE rn = 1"""


@register("sync_edges", "K3 F4 H2 A13", _sync_sql,
          note="two inserts with a sync pass after each; the neighbour graph equals that of one pass over all points")
def q_sync_edges(spark, sf):
    from ..sources.log_store import LogStore
    first, second = _halves(log_lines(spark, sf))
    st = LogStore(spark, _root(spark, "sync"), GATE)
    st.insert(first)
    st.sync()
    st.insert(second)
    st.sync()
    return st.edges().select("src", "dst", F.round("sim", 6).alias("sim"))


STREAM = IG.GateConfig(M.MinHashParams(5, 64, 16, 42, profile="basic"), 0.8, "jaccard")
DOC_ROWS_SQL = """lg AS (SELECT md5(text || '-' || json_object('pod_name', source, 'severity', lang)::VARCHAR) AS id, text, doc_id % 2 = 0 AS first FROM documents)"""


@register("stream_ingest", "K1 K4 F1", lambda: _gate_sql(DOC_ROWS_SQL, STREAM) + """
SELECT id, id AS closest_log_id, 1.0::DOUBLE AS similarity FROM stored
UNION ALL SELECT DISTINCT id, CASE WHEN dup THEN match_id ELSE id END, round(CASE WHEN dup THEN similarity ELSE 1.0 END, 6) FROM dec
WHERE id NOT IN (SELECT id FROM stored)""",
          note="documents as a file stream through foreachBatch(ingest), availableNow, in two runs over one checkpoint: "
               "the second half is matched with what the first one stored, and ids seen before are left out")
def q_stream_ingest(spark, sf):
    docs = table(spark, sf, "documents")
    root = _root(spark, "stream")
    pts, look = S.point_store(spark, root), S.lookup_store(spark, root)
    for half in (0, 1):
        docs.where(F.col("doc_id") % 2 == half).write.parquet(f"{root}/in/half={half}")      # what arrives before a run
        stream = spark.readStream.schema(docs.schema).parquet(f"{root}/in/half=*")
        logs = stream.select(F.col("text"), F.col("source").alias("pod_name"), F.col("lang").alias("severity"),
                             F.timestamp_seconds(F.col("doc_id")).alias("ts"))
        IG.stream_ingest(logs, pts, look, STREAM, root + "/_stream_checkpoint", skip_seen=True).awaitTermination()
    return look.current().select("id", "closest_log_id", F.round("similarity", 6).alias("similarity"))


SEARCH = "ERROR 2024-01-05T00:00:00Z user_id=323e4567-e89b-12d3-a456-426614174131 ip=10.0.1.2 took 50ms code 3 props none"


def _search_sql(cond: str) -> str:
    p = GATE.params
    sig = M.signature_sql("(SELECT DISTINCT id, text FROM lg UNION ALL SELECT 'probe', '" + SEARCH + "')", "id", "text", p)
    eq = (f"list_sum(list_transform(range(1, {p.num_hashes} + 1), lambda i: (a.signature[i] = b.signature[i])::INTEGER)) / {p.num_hashes}")
    return f"""WITH logs AS ({LOG_LINES_SQL}),
lg AS (SELECT md5(text || '-' || json_object('pod_name', pod_name, 'severity', severity)::VARCHAR) AS id, text, severity, pod_name FROM logs),
sig AS ({sig})
SELECT a.id, round({eq}, 6) AS score, severity FROM sig a JOIN sig b ON b.id = 'probe'
JOIN (SELECT DISTINCT id, severity, pod_name FROM lg) l ON l.id = a.id WHERE {cond} ORDER BY {eq} DESC, a.id LIMIT 10"""


def _filled(spark, sf):
    """A log store that holds every log line as a point."""
    from ..sources.log_store import LogStore
    st = LogStore(spark, _root(spark, "search"), GATE)
    st.create()
    rows = IG.embed_logs(log_lines(spark, sf), GATE)
    st.points.upsert(rows.withColumn("sim_sync", F.lit(False)).withColumn("insert_ts", F.lit(None).cast("timestamp")))
    return st


@register("search_text", "D4 D6 A9", lambda: _search_sql("true"))
def q_search_text(spark, sf):
    return _filled(spark, sf).search_text(SEARCH, 10).select("id", F.round("score", 6).alias("score"), "severity")


@register("search_text_filtered", "D5 D7 E2", lambda: _search_sql("severity IN ('VIEW', 'CLICK') AND pod_name <> 'pod-0'"))
def q_search_text_filtered(spark, sf):
    specs = [{"key": "severity", "op": "in", "value": ["VIEW", "CLICK"]}, {"key": "pod_name", "op": "not_in", "value": ["pod-0"]}]
    return _filled(spark, sf).search_text(SEARCH, 10, specs).select("id", F.round("score", 6).alias("score"), "severity")


# Filter 0 or 1 by the parity of the query's id / 20, none for every third query.
BATCH_FILTERS = [[{"key": "severity", "op": "in", "value": ["VIEW", "CLICK"]}], [{"key": "pod_name", "op": "not_in", "value": ["pod-0"]}]]


def _search_batch_sql() -> str:
    p = GATE.params
    sig = M.signature_sql("(SELECT DISTINCT id, text FROM lg)", "id", "text", p)
    eq = f"list_sum(list_transform(range(1, {p.num_hashes} + 1), lambda i: (a.signature[i] = b.signature[i])::INTEGER)) / {p.num_hashes}"
    return f"""WITH logs AS ({LOG_LINES_SQL}),
lg AS (SELECT log_id, md5(text || '-' || json_object('pod_name', pod_name, 'severity', severity)::VARCHAR) AS id, text, severity, pod_name FROM logs),
sig AS ({sig}),
keys AS (SELECT id, dense_rank() OVER (ORDER BY signature) AS k FROM sig),
one AS (SELECT k, any_value(signature) AS signature FROM keys JOIN sig USING (id) GROUP BY k),
pts AS (SELECT DISTINCT id, k, severity IN ('VIEW', 'CLICK') AS f0, pod_name <> 'pod-0' AS f1 FROM lg JOIN keys USING (id)),
asked AS (SELECT log_id AS qid, k, CASE WHEN log_id % 60 = 0 THEN -1 ELSE (log_id // 20) % 2 END AS f FROM lg JOIN keys USING (id) WHERE log_id % 20 = 0),
rated AS (SELECT q.k AS qk, b.k AS pk, {eq} AS score FROM (SELECT DISTINCT k FROM asked) q JOIN one a ON a.k = q.k, one b),
few AS (SELECT *, row_number() OVER (PARTITION BY k, f0, f1 ORDER BY id) AS n FROM pts)
SELECT qid, rank, id, round(score, 6) AS score FROM (
  SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
  FROM asked JOIN rated ON qk = asked.k JOIN few ON few.k = pk AND n <= 5 WHERE f = -1 OR (f = 0 AND f0) OR (f = 1 AND f1)) WHERE rank <= 5"""


@register("batch_search_texts", "D5 D7 H1 E2 E3", _search_batch_sql,
          note="queries: the texts of every log line whose id is divisible by 20, against all stored points, with own filters")
def q_batch_search_texts(spark, sf):
    q = F.col("log_id")
    place = F.when(q % 60 == 0, F.lit(None)).otherwise(F.floor(q / 20) % 2).cast("int")
    texts = log_lines(spark, sf).where(q % 20 == 0).select(q.alias("qid"), "text", place.alias("filter"))
    out = _filled(spark, sf).search_batch(texts, 5, BATCH_FILTERS)
    return out.select("qid", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"))
