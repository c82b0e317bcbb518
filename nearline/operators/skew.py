"""Skew-safe joins: find hot keys with a proven size bound, salt only them.

A key is *hot* when it holds at least ``share`` of all rows.  At most
``1 / share`` keys can be hot, so the hot-key table has a proven bound and may
be broadcast.  Rows of a hot key on the big side are spread over
``n_salt`` sub-keys (about the number of shuffle partitions the key would
fill on its own); the matching rows of the other side are replicated once per
sub-key.  Cold keys keep salt 0 and join as usual.  Nothing is dropped,
capped or sampled: the join result is identical to the plain join.

Everything is lazy: the row total is a scalar subquery, the hot-key table a
broadcast aggregate; no row reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SHARE = 1e-4     # at most 10,000 hot keys


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def is_small(df: DataFrame) -> bool:
    """True where Spark broadcasts the table in a join; the size of a written
    table's files tells."""
    limit = int(df._jdf.sparkSession().sessionState().conf().autoBroadcastJoinThreshold())
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def spread_join(big: DataFrame, written: DataFrame, keys: list[str], how: str = "inner", salt_by: list[str] | None = None) -> DataFrame:
    """``big.join(written, keys, how)`` with a written table: a small one is
    broadcast, so ``big`` is neither counted nor shuffled; else :func:`salted_join`."""
    if how in ("inner", "left", "left_semi", "left_anti") and is_small(written):
        return big.join(F.broadcast(written), keys, how)
    return salted_join(big, written, keys, how, salt_by)


def hot_keys(big: DataFrame, keys: list[str], share: float = DEFAULT_SHARE,
             partitions: int | None = None, total: int | None = None) -> DataFrame:
    """Keys with count >= share * total, plus the salt fan-out ``__n``.

    Output rows <= 1/share (proven), so callers may broadcast it.  ``total``
    (the row count of ``big``) may be passed when the caller knows it, e.g.
    across the rounds of an iteration over a fixed set of rows.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    p = partitions or _partitions(big)
    total = big.select(F.count(F.lit(1))).scalar() if total is None else F.lit(max(int(total), 1))
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__cnt"))
    return (counts.where(F.col("__cnt") >= F.lit(share) * total)
            .select(*keys,
                    F.least(F.lit(p), F.ceil(F.col("__cnt") * F.lit(p) / total)).cast("int").alias("__n")))


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], how: str = "inner",
                salt_by: list[str] | Column | None = None, share: float = DEFAULT_SHARE,
                partitions: int | None = None, total: int | None = None) -> DataFrame:
    """``big.join(other, keys, how)`` with hot keys of ``big`` split up.

    ``salt_by``: deterministic columns of ``big`` spreading a hot key's rows
    (default: all of its columns), so task retries give the same salt.
    ``how`` must keep the left side's rows whole: inner, left, left_semi or
    left_anti (a right or full join would repeat unmatched right rows once
    per salt).
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"salted_join supports inner/left/left_semi/left_anti, not {how!r}")
    hot = F.broadcast(hot_keys(big, keys, share, partitions, total))
    if salt_by is None:
        salt_src = F.xxhash64(*[F.col(c) for c in big.columns])
    elif isinstance(salt_by, Column):
        salt_src = salt_by
    else:
        salt_src = F.xxhash64(*[F.col(c) for c in salt_by])
    b = (big.join(hot, keys, "left")
         .withColumn("__salt", F.when(F.col("__n").isNull(), F.lit(0))
                     .otherwise(F.pmod(salt_src, F.col("__n"))).cast("int"))
         .drop("__n"))
    o = (other.join(hot, keys, "left")
         .withColumn("__salt", F.explode(F.when(F.col("__n").isNull(), F.array(F.lit(0)))
                                         .otherwise(F.sequence(F.lit(0), F.col("__n") - 1))))
         .drop("__n"))
    return b.join(o, keys + ["__salt"], how).drop("__salt")
