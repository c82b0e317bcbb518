"""Exact medians by distributed selection.

``percentile`` and ``median`` hold all distinct values of a group in one buffer.
Here a group's values never meet: equal values of a group become one row with
their number first (a combinable count), then passes narrow the rows that can
still hold the group's middle:

1. an approximate quantile sketch per group (bounded, combinable) gives
   ``bins - 1`` cut points;
2. a combinable sum counts every (group, bin) exactly;
3. the bins with the group's two middle ranks stay, and the rows below them
   are remembered as a number.

The sketch only decides how much a pass narrows, never the result.  Passes go
on until every group has ``keep`` rows at most, whose running count then
gives the middle values.  Groups that are small from the start take no pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import salted_join


def exact_median(df: DataFrame, keys: list[str], value: str, bins: int = 64, keep: int = 5000) -> DataFrame:
    """``(keys..., median, n_values)``: the mean of the two middle values (the
    middle one for odd counts) of every group's non-null values, as a double.
    A group whose values are all null has a null median and 0 values; null
    keys are a group; NaN is greater than any number.
    """
    if bins < 8 or keep < 8:                                          # a pass leaves two bins at most
        raise ValueError("bins and keep from 8")
    group = F.struct(*[F.col(k) for k in keys])
    rows = df.select(F.to_json(group, {"ignoreNullFields": "false"}).alias("__g"), *keys, F.col(value).cast("double").alias("__v"))
    # The groups themselves (also those of nulls only), one row each.
    names = rows.groupBy("__g").agg(*[F.first(k).alias(k) for k in keys], F.count("__v").alias("n_values"))
    names = cut_lineage(names, "median_groups")
    left = rows.where("__v IS NOT NULL").groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__times"))
    ranks = names.where("n_values > 0").select("__g", F.floor((F.col("n_values") - 1) / 2).alias("__lo"), F.floor(F.col("n_values") / 2).alias("__hi"),
                                               F.lit(0).cast("long").alias("__below"))
    left = cut_lineage(left, "median_values")
    while True:
        size = left.groupBy("__g").agg(F.count(F.lit(1)).alias("__rows"))
        large = cut_lineage(size.where(F.col("__rows") > keep).select("__g"), "median_large")
        if large.isEmpty():
            break
        left, ranks = _narrowed(left, ranks, large, bins)
    at = Window.partitionBy("__g").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    placed = (left.join(ranks, "__g").withColumn("__first", F.col("__below") + F.coalesce(F.sum("__times").over(at), F.lit(0))))
    holds = lambda r: (F.col(r) >= F.col("__first")) & (F.col(r) < F.col("__first") + F.col("__times"))
    middle = placed.groupBy("__g").agg(F.max(F.when(holds("__lo"), F.col("__v"))).alias("__a"), F.max(F.when(holds("__hi"), F.col("__v"))).alias("__b"))
    # The same value twice is itself, also where a sum would leave the doubles.
    median = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.col("__a") / 2 + F.col("__b") / 2)
    return names.join(middle, "__g", "left").select(*keys, median.alias("median"), "n_values")


def _narrowed(left: DataFrame, ranks: DataFrame, large: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """One pass over the large groups; the others stay as they are."""
    rows = salted_join(left, large, ["__g"], "left_semi", salt_by=["__v"])
    share = [k / bins for k in range(1, bins)]
    cuts = rows.groupBy("__g").agg(F.array_distinct(F.percentile_approx("__v", share, 20 * bins)).alias("__cuts"))
    binned = salted_join(rows, cuts, ["__g"], "inner", salt_by=["__v"]).withColumn(
        "__bin", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    binned = cut_lineage(binned, "median_bins")
    count = binned.groupBy("__g", "__bin").agg(F.sum("__times").alias("__sum"))                # at most `bins` rows a group
    at = Window.partitionBy("__g").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = count.join(ranks, "__g").withColumn("__first", F.col("__below") + F.coalesce(F.sum("__sum").over(at), F.lit(0)))
    last = F.col("__first") + F.col("__sum")
    holds = lambda r: (F.col(r) >= F.col("__first")) & (F.col(r) < last)
    found = placed.groupBy("__g").agg(
        F.max(F.when(holds("__lo"), F.col("__bin"))).alias("__b1"), F.max(F.when(holds("__hi"), F.col("__bin"))).alias("__b2"),
        F.max(F.when(holds("__lo"), F.col("__first"))).alias("__before"))
    found = cut_lineage(found, "median_found")
    # Nothing can lie between the two middle ranks, so no row between their bins counts.
    some = salted_join(binned, found, ["__g"], "inner", salt_by=["__v"]).where((F.col("__bin") == F.col("__b1")) | (F.col("__bin") == F.col("__b2")))
    stay = salted_join(left, large, ["__g"], "left_anti", salt_by=["__v"])
    new = ranks.join(found.select("__g", "__before"), "__g", "left").select("__g", "__lo", "__hi", F.coalesce("__before", "__below").alias("__below"))
    return (cut_lineage(stay.unionByName(some.select("__g", "__v", "__times")), "median_values"), cut_lineage(new, "median_ranks"))
