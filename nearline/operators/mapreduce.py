"""Chunked map / reduce and linear chains.

A "chunk" is a key range (``floor(key / size)``), never a position from an
unpartitioned ``row_number``.  Partial results per chunk are ordinary
aggregates (map-side combine); the total is a second, one-row aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_id(key: Column, size: int) -> Column:
    """H9: chunk of a dense non-negative key; the last chunk may be short."""
    if size <= 0:
        raise ValueError("chunk size must be > 0")
    return F.floor(key / F.lit(size)).cast("bigint")


def chunk_partials(df: DataFrame, key: str, value: Column, size: int) -> DataFrame:
    """``(chunk_id, n, partial)`` with partial = sum of value squared."""
    return df.groupBy(chunk_id(F.col(key), size).alias("chunk_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value * value).alias("partial"))


def sum_of_squares(df: DataFrame, value: Column) -> DataFrame:
    """Total of squares (one aggregate; partial sums run map-side)."""
    return df.agg(F.sum(value * value).alias("total"), F.count(F.lit(1)).alias("n"))


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """K7: each step takes the former result (``DataFrame.transform``)."""
    for step in steps:
        df = df.transform(step)
    return df
