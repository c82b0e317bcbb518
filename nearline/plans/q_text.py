"""Text, hash, record and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as CAL
from ..functions import hashing as H
from ..functions import records as R
from ..functions.text import normalise, normalise_sql
from ..operators import minhash as M
from ..session import spread
from ..sources.tables import LOG_LINES_SQL, log_lines, log_text, pod_name, table
from .registry import register

L = f"({LOG_LINES_SQL})"


@register("mask_basic", "B1 B17 B18", f"SELECT log_id, {normalise_sql('text', 'basic')} AS norm FROM {L}")
def q_mask_basic(spark, sf):
    return log_lines(spark, sf).select("log_id", normalise(F.col("text"), "basic").alias("norm"))


SKIP_LA = ("long_token",)


@register("mask_full", "B1 B2 B3 B4 B5 B6 B7 B8 B9 B10 B11 B12 B13 B15 B16 B17",
          f"SELECT log_id, {normalise_sql('text', 'full', skip=SKIP_LA)} AS norm FROM {L}")
def q_mask_full(spark, sf):
    return log_lines(spark, sf).select("log_id", normalise(F.col("text"), "full", skip=SKIP_LA).alias("norm"))


@register("mask_full_lookahead", "B14", None,
          note="all rules incl. the look-ahead long-token rule; RE2 cannot run it (pytest covers it)")
def q_mask_full_lookahead(spark, sf):
    return log_lines(spark, sf).select("log_id", normalise(F.col("text"), "full").alias("norm"))


@register("mask_documents", "B1 B6 B7 B10 B11 B12 B13 B15 B16 B17", None,
          note="Unicode word boundaries (as Python's re); RE2's ASCII \\b differs next to accented "
               "letters, so the check is pytest against Python re on sample texts")
def q_mask_documents(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", normalise(F.col("text"), "full", skip=SKIP_LA).alias("norm"))


GATE = M.MinHashParams(shingle_size=5, num_hashes=16, bands=8, seed=42, profile="basic", stop_short_lines=100)


def _short_gate_sql():
    g = M.grams_sql("documents", "doc_id", "text", GATE)
    norm = GATE.norm_sql("text")
    return (f"SELECT d.doc_id, (length({norm}) < {GATE.stop_short_lines}) AS is_short, "
            f"coalesce(c.n, 0)::INTEGER AS shingle_count "
            f"FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT gram_hash) AS n FROM ({g}) GROUP BY doc_id) c "
            f"USING (doc_id)")


@register("short_line_gate", "B19 C1", _short_gate_sql)
def q_short_line_gate(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    n = M.embed_rows(docs, "text", GATE, keep_norm=True)
    return n.select("doc_id", (F.length("norm") < GATE.stop_short_lines).alias("is_short"), "shingle_count")


@register("content_id", "B20 B21", """
SELECT doc_id, md5(text) AS md5_hex,
  ('0x' || substr(md5(text), 18, 15))::BIGINT % 1000 AS md5_mod,
  md5(text || '-' || json_object('lang', lang, 'source', source)::VARCHAR) AS content_id
FROM documents""")
def q_content_id(spark, sf):
    d = table(spark, sf, "documents")
    meta = F.to_json(F.struct("lang", "source"))
    return d.select("doc_id", H.md5_hex(F.col("text")).alias("md5_hex"),
                    H.md5_mod(F.col("text"), 1000).alias("md5_mod"),
                    H.content_id(F.col("text"), meta).alias("content_id"))


def _records(spark, sf):
    ev = table(spark, sf, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    et = F.col("event_type")
    ins = (F.when(et == "view", F.lit(None).cast("string"))
           .when(et == "click", F.concat(iso, F.lit(".123456Z")))
           .when(et == "signup", F.concat(iso, F.lit("+00:00")))
           .when(et == "error", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("Z")))
           .otherwise(F.concat(iso, F.lit("Z"))))
    rows = ev.select(F.col("event_id").alias("log_id"), log_text().alias("text"), pod_name().alias("pod_name"), iso.alias("iso"),
                     F.upper("event_type").alias("severity"), ins.alias("insert_timestamp"))
    meta = F.struct("pod_name", F.concat("iso", F.lit("Z")).alias("timestamp"), "severity", F.col("text").alias("textPayload"))
    return rows.select("log_id", "text", meta.alias("metadata"), "insert_timestamp")


RECORDS_SQL = f"""
SELECT l.log_id, CASE
  WHEN e.event_type = 'view' THEN NULL
  WHEN e.event_type = 'click' THEN strftime(l.ts, '%Y-%m-%dT%H:%M:%S') || '.123456Z'
  WHEN e.event_type = 'signup' THEN strftime(l.ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'
  WHEN e.event_type = 'error' THEN strftime(l.ts, '%Y-%m-%d %H:%M:%S') || 'Z'
  ELSE strftime(l.ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS insert_timestamp
FROM {L} l JOIN events e ON e.event_id = l.log_id"""


@register("validate_records", "A1 A2", f"""
SELECT log_id, insert_timestamp IS NULL OR regexp_matches(insert_timestamp, '{R.ISO_UTC}') AS valid,
  CASE WHEN insert_timestamp IS NULL OR regexp_matches(insert_timestamp, '{R.ISO_UTC}') THEN NULL
       ELSE 'insert_timestamp must be in ISO 8601 UTC format' END AS error
FROM ({RECORDS_SQL})""")
def q_validate_records(spark, sf):
    return R.check_records(_records(spark, sf)).select("log_id", "valid", "error")


@register("stamp_check", "A1 A2 B22", f"""
SELECT log_id, insert_timestamp IS NULL AS stamped, true AS stamp_ok
FROM ({RECORDS_SQL}) WHERE insert_timestamp IS NULL OR regexp_matches(insert_timestamp, '{R.ISO_UTC}')""")
def q_stamp_check(spark, sf):
    recs = _records(spark, sf).withColumn("stamped", F.col("insert_timestamp").isNull())
    good, _rejects = R.split_records(recs)
    return good.select("log_id", "stamped", F.col("insert_timestamp").rlike(R.ISO_UTC).alias("stamp_ok"))


def _month_raw():
    p = F.col("o_orderpriority")
    full = F.date_format("o_orderdate", "MMMM")
    return (F.when(p.startswith("1"), F.lower(full))
            .when(p.startswith("2"), F.concat(F.lit(" "), F.upper(F.date_format("o_orderdate", "MMM")), F.lit(" ")))
            .when(p.startswith("3"), full)
            .when(p.startswith("4"), F.concat(F.lower(F.date_format("o_orderdate", "MMM")), F.lit("xyz")))
            .otherwise(F.concat(F.lit("m"), F.month("o_orderdate").cast("string"))))


MONTH_RAW_SQL = """CASE
  WHEN starts_with(o_orderpriority, '1') THEN lower(strftime(o_orderdate, '%B'))
  WHEN starts_with(o_orderpriority, '2') THEN ' ' || upper(strftime(o_orderdate, '%b')) || ' '
  WHEN starts_with(o_orderpriority, '3') THEN strftime(o_orderdate, '%B')
  WHEN starts_with(o_orderpriority, '4') THEN lower(strftime(o_orderdate, '%b')) || 'xyz'
  ELSE 'm' || month(o_orderdate)::VARCHAR END"""

MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in CAL.MONTHS) + "]"
FULL_SQL = "MAP {" + ", ".join(f"'{f}': '{m}'" for f, m in zip(CAL.FULL_NAMES, CAL.MONTHS)) + "}"


def normalise_month_sql(x: str) -> str:
    t = f"trim({x})"
    m3 = f"upper(substr(lower({t}), 1, 1)) || substr(lower({t}), 2, 2)"
    return (f"CASE WHEN {t} = '' THEN {t} WHEN {FULL_SQL}[lower({t})] IS NOT NULL THEN {FULL_SQL}[lower({t})] "
            f"WHEN list_contains({MONTHS_SQL}, {m3}) THEN {m3} ELSE {t} END")


@register("month_normalise", "B23", f"""
SELECT o_orderkey, raw, {normalise_month_sql('raw')} AS month
FROM (SELECT o_orderkey, {MONTH_RAW_SQL} AS raw FROM orders)""")
def q_month_normalise(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", _month_raw().alias("raw"))
    return o.select("o_orderkey", "raw", CAL.normalise_month(F.col("raw")).alias("month"))


@register("month_shift", "B24", f"""
SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, strftime(o_orderdate, '%b') AS month,
  floor((year(o_orderdate) * 12 + month(o_orderdate) - 1 - 2) / 12)::INTEGER AS prev_year,
  {MONTHS_SQL}[((year(o_orderdate) * 12 + month(o_orderdate) - 1 - 2) % 12) + 1] AS prev_month,
  floor((year(o_orderdate) * 12 + month(o_orderdate) - 1 + 2) / 12)::INTEGER AS next_year,
  {MONTHS_SQL}[((year(o_orderdate) * 12 + month(o_orderdate) - 1 + 2) % 12) + 1] AS next_month
FROM orders""")
def q_month_shift(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"),
                                          F.date_format("o_orderdate", "MMM").alias("month"))
    py, pm = CAL.add_months(F.col("year"), F.col("month"), -2)
    ny, nm = CAL.add_months(F.col("year"), F.col("month"), 2)
    return o.select("o_orderkey", "year", "month", py.alias("prev_year"), pm.alias("prev_month"),
                    ny.alias("next_year"), nm.alias("next_month"))
