"""Readers for the driver's parquet tables and the derived ``log_lines`` input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _uuid_like(h):
    """8-4-4-4-12 layout of a 32-hex-digit md5, version 4 / variant 8."""
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("4"), F.substring(h, 14, 3)),
                       F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def log_text() -> Column:
    """The log line of an ``events`` row.

    ``LEVEL 2024-01-01T00:00:07Z user_id=<uuid> ip=10.0.a.b took 7ms code c
    span=<hex> k=<props.k>`` - gives every masking rule something to do.
    """
    h = F.md5(F.col("user_id").cast("string"))
    return F.concat(
        F.upper("event_type"), F.lit(" "),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(" user_id="), _uuid_like(h),
        F.lit(" ip=10.0."), F.pmod("user_id", F.lit(256)).cast("string"), F.lit("."),
        F.pmod("event_id", F.lit(256)).cast("string"),
        F.lit(" took "), F.round("value").cast("bigint").cast("string"), F.lit("ms code "),
        F.pmod("event_id", F.lit(7)).cast("string"),
        F.lit(" trace "), F.substring(F.md5(F.col("event_id").cast("string")), 1, 20),
        F.lit(" at "), F.date_format("ts", "HH:mm:ss"),
        F.lit(" mail ops"), F.pmod("user_id", F.lit(9)).cast("string"), F.lit("@example.org"),
        F.lit(" props "), F.col("props"))


def pod_name() -> Column:
    """The pod of an ``events`` row."""
    return F.concat(F.lit("pod-"), F.pmod("user_id", F.lit(5)).cast("string"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines derived row by row from ``events`` (one per event)."""
    from ..session import spread
    # Regex-heavy consumers follow (half a millisecond a row); use every core even if events
    # scan as one split, in tasks of some 200,000 rows.
    ev = spread(table(spark, sf_dir, "events"), "event_id", part_bytes=4 << 20)
    return ev.select(F.col("event_id").alias("log_id"), log_text().alias("text"), "ts", "user_id",
                     F.upper("event_type").alias("severity"), pod_name().alias("pod_name"))


LOG_LINES_SQL = """
SELECT event_id AS log_id,
  upper(event_type) || ' ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
  || ' user_id=' || substr(md5(user_id::VARCHAR), 1, 8) || '-' || substr(md5(user_id::VARCHAR), 9, 4)
  || '-4' || substr(md5(user_id::VARCHAR), 14, 3) || '-8' || substr(md5(user_id::VARCHAR), 18, 3)
  || '-' || substr(md5(user_id::VARCHAR), 21, 12)
  || ' ip=10.0.' || (user_id % 256)::VARCHAR || '.' || (event_id % 256)::VARCHAR
  || ' took ' || round(value)::BIGINT::VARCHAR || 'ms code ' || (event_id % 7)::VARCHAR
  || ' trace ' || substr(md5(event_id::VARCHAR), 1, 20)
  || ' at ' || strftime(ts, '%H:%M:%S')
  || ' mail ops' || (user_id % 9)::VARCHAR || '@example.org'
  || ' props ' || props AS text,
  ts, user_id, upper(event_type) AS severity, 'pod-' || (user_id % 5)::VARCHAR AS pod_name
FROM events
"""
