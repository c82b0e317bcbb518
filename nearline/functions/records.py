"""Log-record validation and stamping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed value: accepted insert_timestamp form (UTC, 'Z' only, anchored).
ISO_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
# --- end of fixed values

RECORD_SCHEMA = T.StructType([
    T.StructField("text", T.StringType(), True),
    T.StructField("metadata", T.StructType([
        T.StructField("pod_name", T.StringType(), True),
        T.StructField("timestamp", T.StringType(), True),
        T.StructField("severity", T.StringType(), True),
        T.StructField("textPayload", T.StringType(), True),
    ]), True),
    T.StructField("insert_timestamp", T.StringType(), True),
])


def utc_now_iso() -> Column:
    """Current UTC time as ``yyyy-MM-ddTHH:mm:ss.ffffffZ``."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def timestamp_ok(c: Column) -> Column:
    """A2: null (to be stamped) or the anchored ISO-UTC form."""
    return c.isNull() | c.rlike(ISO_UTC)


def check_records(df: DataFrame, text: str = "text", metadata: str = "metadata",
                  ts: str = "insert_timestamp") -> DataFrame:
    """A1+A2: add ``valid`` and ``error`` columns (first failing rule)."""
    err = (F.when(F.col(text).isNull(), F.lit("missing text"))
           .when(F.col(metadata).isNull(), F.lit("missing metadata"))
           .when(~timestamp_ok(F.col(ts)), F.lit("insert_timestamp must be in ISO 8601 UTC format")))
    return df.withColumn("error", err).withColumn("valid", F.col("error").isNull())


def split_records(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """A1 batch mode: (good rows stamped with B22 where needed, rejects)."""
    checked = check_records(df, **kw)
    ts = kw.get("ts", "insert_timestamp")
    good = (checked.where("valid").drop("valid", "error")
            .withColumn(ts, F.coalesce(F.col(ts), utc_now_iso())))
    return good, checked.where(~F.col("valid")).drop("valid")


def require_valid(df: DataFrame, **kw) -> DataFrame:
    """A1 strict mode: the job fails on the first bad record."""
    checked = check_records(df, **kw)
    # In a filter: a raise inside a column would go with the column.
    fails = F.raise_error(F.col("error")).cast("boolean")
    return checked.where(F.when(F.col("valid"), F.lit(True)).otherwise(fails)).drop("error", "valid")
