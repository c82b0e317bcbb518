"""Mixing sources to target weights by Efraimidis-Spirakis sampling.
DataFrame functions only.

Targets: the sources share ``share`` of all words by weight; a target stops
at ``cap`` times its source's size and the excess is reshared by weight among
the rest until none is above.  That is min(cap * size, weight * level) with
one level for all, which a running sum over the sources, sorted by size per
weight, gives at once.

Selection: a target holds whole epochs of its source first (every document
once each); the rest is a fractional epoch.  Each document draws the key
-ln(u) / quality, u a hash of id and text in (0, 1): the documents with the
smallest keys are an Efraimidis-Spirakis sample without replacement.  They
are taken in order of the key until the words left are used up; the document
at the edge gives just the words that are missing.

No source is ever sorted as a whole.  Keys are mapped to (0, 1) and cut into
equal bins; words are summed by source and bin (combinable), a running sum
over a source's bins finds the one where the rest runs out, and only that
bin's documents are sorted, to find the edge key.  Every document is then
compared with the edge of its source.

Defined cases: a null text has no words; a null source is a source of its
own, last in order; rows equal in id and text draw the same key and share
the missing words evenly, rounded down; sources without words get target 0;
empty tables give no rows; input columns of any name are carried in ``__row``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACE


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    rows_per_bin: int = 4000


def quality_weight(text: Column) -> Column:
    """Share of characters that are no signs, squared, at least 0.05."""
    n = F.char_length(text)
    clean = F.char_length(F.translate(text, "#*$%&|<>!", "")) / n
    return F.coalesce(F.when(n > 0, F.greatest(F.lit(0.05), clean * clean)), F.lit(0.05))


def sizes(docs: DataFrame) -> DataFrame:
    """Every row as ``__row`` with its source, words, key and tie-breaker."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0 ** 52)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                       F.struct(F.col("source").isNull().alias("last"), F.col("source").alias("name")).alias("source"),
                       F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("size"),
                       (-F.log(u) / quality_weight(text)).alias("key"), digest.alias("tie"))


def targets(sources: DataFrame, p: MixParams) -> DataFrame:
    """From ``(source, source_size)`` to the target of each source.  The
    windows run over one row per source, never over documents."""
    every = Window.orderBy("source")
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, p.weights)), ((F.row_number().over(every) - 1) % len(p.weights)) + 1).cast("double"))
    by_fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.lit(p.share) * F.sum("source_size").over(whole) - F.lit(float(p.cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    leveled = ranked.withColumn("level", level)
    # Sources that lie under the level even when all smaller ones are full fix it.
    fits = F.when(F.col("level") * F.col("weight") <= F.lit(float(p.cap)) * F.col("source_size"), F.col("level"))
    leveled = leveled.withColumn("common", F.first(fits, ignorenulls=True).over(whole))
    full = F.lit(float(p.cap)) * F.col("source_size")
    return leveled.select("source", "source_size", F.least(full, F.coalesce(F.col("common") * F.col("weight"), full)).alias("target"))


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Every row of ``docs`` as ``__row`` with ``size, source_size, target,
    epochs`` (of its source) and ``taken`` (words the mix takes of it)."""
    sized = sizes(docs)
    narrow = cut_lineage(sized.select("source", "size", "key", "tie"), "mix_sizes")
    rows = narrow.count()
    bins = max(16, rows // p.rows_per_bin)
    binned = narrow.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * bins))
    by_bin = binned.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    by_bin = cut_lineage(by_bin, "mix_bins")
    words = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut_lineage(targets(by_bin.groupBy("source").agg(F.sum("words").alias("source_size")), p)
                       .withColumn("epochs", epochs).withColumn("rest", words - F.col("epochs") * F.col("source_size")), "mix_targets")
    # The bin of each source in which the rest runs out.
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edge_bins = (by_bin.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).join(plan, "source")
                 .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
                 .select("source", "bin", (F.col("rest") - F.col("before")).alias("left")))
    # Its documents in order; rows of one key count together.
    keys = binned.join(edge_bins, ["source", "bin"]).groupBy("source", "left", "key", "tie").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("source").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    edges = (keys.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
             .where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
             .select("source", F.struct("key", "tie").alias("edge"), F.floor((F.col("left") - F.col("before")) / F.col("n")).cast("long").alias("edge_take")))
    edges = cut_lineage(plan.join(edges, "source", "left"), "mix_edges")
    own = F.struct("key", "tie")
    # Without an edge the rest is 0 (nothing left over) or all of the source.
    part = (F.when(F.col("edge").isNull(), F.when(F.col("rest") >= F.col("source_size"), F.col("size")).otherwise(0))
            .when(own < F.col("edge"), F.col("size")).when(own == F.col("edge"), F.col("edge_take")).otherwise(0))
    return (sized.join(edges, "source")
            .select("__row", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")))
