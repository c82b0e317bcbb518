"""Monthly metric look-ups, hot-service flags, ±N-month bill windows and
spike detection (A14, E19, F7, F8, G5, G6, H8).

The ±N window is an equi-join on a dense month number after exploding the
N offsets (``sequence(-n, n)``), not a range or nested-loop join: each
anchor row becomes 2n+1 keyed rows and the join shuffles (or broadcasts,
when small) on the month key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as CAL

SPIKE_RATIO = 1.15


def month_key(year: Column, month: Column) -> Column:
    """Dense month serial from (year, month name)."""
    return year.cast("int") * 12 + CAL.month_index(CAL.normalise_month(month))


def lookup(metrics: DataFrame, lookups: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """left join the requests to the metric table; misses carry an error text."""
    j = lookups.join(metrics.select(*keys, value), keys, "left")
    return j.withColumn("error", F.when(F.col(value).isNull(), F.lit(f"{label} data not found")))


def hot(metrics: DataFrame, value: str, threshold: float) -> DataFrame:
    """Strictly above the threshold."""
    return metrics.where(F.col(value) > F.lit(threshold))


def window_rows(anchors: DataFrame, anchor_key: str, series: DataFrame, series_key: str, n: int = 2) -> DataFrame:
    """F8/H8: every series row within ``n`` months of each anchor row."""
    ex = anchors.withColumn("offset", F.explode(F.sequence(F.lit(-n), F.lit(n)))) \
        .withColumn("__k", F.col(anchor_key) + F.col("offset"))
    return ex.join(series.withColumnRenamed(series_key, "__k"), "__k").drop("__k")


def spikes(window: DataFrame, group: list[str], value: str, ratio: float = SPIKE_RATIO) -> DataFrame:
    """Window median per group; rows with value >= median * ratio are spikes.

    Returns ``(group..., median, n_values, n_spikes, spike_found)``; groups
    without any value report ``no bill values``.
    """
    med = window.groupBy(*group).agg(F.median(value).alias("median"), F.count(value).alias("n_values"))
    flagged = window.join(med, group).withColumn(
        "is_spike", F.col(value).isNotNull() & (F.col(value) >= F.col("median") * F.lit(ratio)))
    return flagged.groupBy(*group).agg(
        F.first("median").alias("median"), F.first("n_values").alias("n_values"),
        F.sum(F.col("is_spike").cast("int")).cast("int").alias("n_spikes")) \
        .withColumn("spike_found", F.col("n_spikes") > 0) \
        .withColumn("reason", F.when(F.col("n_values") == 0, F.lit("no bill values")))


def nest(df: DataFrame, outer: str, mid: str, inner: str, value: str) -> DataFrame:
    """Build ``outer -> {mid -> {inner -> value}}`` maps (one row per outer key).

    Only for calendar-bounded inner levels (years x 12 months per key).
    """
    level2 = df.groupBy(outer, mid).agg(F.map_from_entries(F.collect_list(F.struct(inner, value))).alias("m"))
    return level2.groupBy(outer).agg(F.map_from_entries(F.collect_list(F.struct(mid, "m"))).alias("metrics"))


def explode_nested(nested: DataFrame, outer: str, mid: str, inner: str, value: str) -> DataFrame:
    """Nested map rows back to ``(outer, mid, inner, value)``."""
    a = nested.select(outer, F.explode("metrics").alias(mid, "__m"))
    return a.select(outer, mid, F.explode("__m").alias(inner, value))
