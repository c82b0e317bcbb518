"""Idempotent processing, structured error rows and dead-letter routing (K4-K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skip_done(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """K4: ``status`` = ``already_done`` for keys in the done table, else ``ok``.

    A left join on the key (the done table is keyed, so no row multiplies).
    """
    d = done.select(key).distinct().withColumn("__done", F.lit(True))
    return batch.join(d, key, "left").withColumn(
        "status", F.when(F.col("__done"), F.lit("already_done")).otherwise(F.lit("ok"))).drop("__done")


def new_only(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """K4: the rows still to process (``left_anti``)."""
    return batch.join(done.select(key), key, "left_anti")


def first_half_done(events: DataFrame) -> DataFrame:
    """Done set for the demo: events before the midpoint of the time range."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    mid = events.select((F.min(us) + F.floor((F.max(us) - F.min(us)) / 2)).alias("m")).scalar()
    return events.where(us < mid).select("event_id")


def safe_divide(num: Column, den: Column) -> Column:
    """K5: ``struct(ok, value, error)``; a zero divisor is an error row, not a failure."""
    q = F.try_divide(num, den)
    bad = den.isNull() | (den == 0)
    return F.struct((~bad).alias("ok"), F.when(~bad, q).alias("value"),
                    F.when(bad, F.lit("division by zero")).alias("error"))


def route(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """K6: split into (good, dead letter) on a row condition."""
    flag = F.coalesce(ok, F.lit(False))
    return df.where(flag), df.where(~flag)


def route_attempts(df: DataFrame, ok: Column, attempts: Column, cap: int) -> DataFrame:
    """K6 with an attempt cap: ``route`` is ``good``, ``retry`` (failed with
    attempts left) or ``rejected``, ``next_attempt`` the number of the next try."""
    flag = F.coalesce(ok, F.lit(False))
    left = F.coalesce(attempts, F.lit(0)) < F.lit(cap)
    route = F.when(flag, "good").when(left, "retry").otherwise("rejected")
    return df.withColumn("route", route).withColumn("next_attempt", F.when(F.col("route") == "retry", F.coalesce(attempts, F.lit(0)) + 1))


def write_rejects(routed: DataFrame, path: str) -> None:
    """K6: append the rejected rows to the rejects folder."""
    routed.where(F.col("route") == "rejected").drop("route", "next_attempt").write.mode("append").parquet(path)
