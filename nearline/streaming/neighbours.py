"""Neighbour graph of a point store, kept up by a sync pass.

Every stored point has an edge to its nearest other point: the best of all
points that share a band with it, by the configured metric, ties to the
smaller id.  Edges stand in a table of their own beside the points.

A pass looks at changed neighbourhoods only.  The unsynced points are matched
against all points that share a band with them (their edges), and the synced
points among those are matched against the unsynced ones: an edge moves where
a new point is better.  Both go through the band index, equal signatures are
compared once.  All points looked at are marked as synced, those without a
partner too.  Two passes after two inserts give the edges of one pass after
both.  :func:`forget` takes deleted points out: points whose nearest went are
unsynced again, so the next pass finds their next nearest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import is_small, spread_join
from ..operators.tiles import best_matches
from ..session import cut_lineage
from ..sources.band_index import band_rows, first_ids, keyed, similarity_blocks, whole_rows
from ..sources.store import TableStore

EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("sim", T.DoubleType())])


def edge_store(points: TableStore) -> TableStore:
    return TableStore(points.spark, points.root + "-edges", EDGES, "src", "last_wins", compact_every=8)


def _signatures(members: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Members by signature, with the two smallest ids of each; ``whole`` has the
    signatures where ``members`` are keys and ids only."""
    first = first_ids(members)
    second = (spread_join(members.select("key", "id"), first.select("key", F.col("id").alias("first")), ["key"], "inner", salt_by=["id"])
              .where("id <> first").groupBy("key").agg(F.min("id").alias("second")))
    if whole is not None:
        members = whole.join(members.select("id"), "id", "left_semi") if not is_small(first) else whole
    return whole_rows(members, first).join(second, "key", "left")


def _edges_of(members: DataFrame, matches: DataFrame, twins: DataFrame) -> DataFrame:
    """``(src, dst, sim)``: the better of the best other signature and the
    smallest other point of the own signature (which is equal: 1.0)."""
    known = cut_lineage(matches.join(twins.select("key", "id", "second"), "key", "full"), "signature_matches")
    both = spread_join(members.select(F.col("id").alias("src"), "key"), known, ["key"], "inner", salt_by=["src"])
    twin = F.when(F.col("src") != F.col("id"), F.col("id")).otherwise(F.col("second"))
    pairs = F.array(F.struct((-F.col("similarity")).alias("c"), F.col("match_id").alias("dst")), F.struct(F.lit(-1.0).alias("c"), twin.alias("dst")))
    best = F.array_min(F.filter(pairs, lambda p: p["dst"].isNotNull()))
    return both.select("src", best.alias("b")).where("b IS NOT NULL").select("src", F.col("b.dst").alias("dst"), (-F.col("b.c")).alias("sim"))


def nearest_edges(members: DataFrame, metric: str) -> DataFrame:
    """``(src, dst, sim)`` among the members ``(id, key, signature, bands)``
    themselves; a member alone in all its bands has none."""
    members = cut_lineage(members, "members")
    sigs = cut_lineage(_signatures(members), "member_signatures")
    bands = cut_lineage(band_rows(sigs), "member_bands")
    # Two points of one signature are as similar as can be; other signatures differ in a place.
    alone = sigs.where("second IS NULL") if metric == "jaccard" else sigs
    asks = bands.join(alone.select("key"), "key", "left_semi") if metric == "jaccard" else bands
    found = best_matches(alone, sigs, asks, bands, similarity_blocks(metric), exclude_same=True)
    return _edges_of(members, found, sigs)


def sync(points: TableStore, metric: str = "cosine", epoch: int | None = None, writer: str = "sync") -> DataFrame:
    """One pass; returns the edges that it wrote."""
    from .ingest import band_index, mark_synced
    edges, index = edge_store(points), band_index(points)
    epoch = points.next_epoch(writer) if epoch is None else epoch
    place = points.place(writer, epoch)                       # the pass sees what was written before its marks
    index.catch_up(points, place)
    fresh = cut_lineage(keyed(points.current(place).where(~F.coalesce("sim_sync", F.lit(False)))), "unsynced")
    new = cut_lineage(_signatures(fresh), "unsynced_signatures")
    asked = cut_lineage(band_rows(new), "unsynced_bands")
    entries = cut_lineage(index.bands.lookup(asked.select("bk"), on="bk").select("bk", "key"), "stored_bands")
    near = cut_lineage(index.members.lookup(entries.select("key"), on="key"), "stored_members")
    old = cut_lineage(_signatures(near), "stored_signatures")
    costs = similarity_blocks(metric)

    forward = best_matches(new, old, asked, entries, costs, exclude_same=True)
    here = _edges_of(fresh, forward, old.join(new.select("key"), "key", "left_semi"))
    # Synced points that share a band with an unsynced one: is that one better?
    stale = cut_lineage(near.select("id", "key").join(fresh.select("id"), "id", "left_anti"), "synced_near")
    others = cut_lineage(_signatures(stale, near), "synced_signatures")
    back = best_matches(others, new, band_rows(others).join(asked.select("bk").distinct(), "bk", "left_semi"), asked, costs, exclude_same=True)
    twins = new.select("key", "id", F.lit(None).cast("string").alias("second"))
    offers = _edges_of(stale, back, twins)
    known = edges.lookup(stale.select("id")).select("src", F.col("dst").alias("__dst"), F.col("sim").alias("__sim"))
    better = F.col("__dst").isNull() | (F.col("sim") > F.col("__sim")) | ((F.col("sim") == F.col("__sim")) & (F.col("dst") < F.col("__dst")))
    moved = offers.join(known, "src", "left").where(better).select("src", "dst", "sim")
    out = cut_lineage(here.unionByName(moved), "sync_edges")
    edges.put(out.withColumn("__deleted", F.lit(False)), place, "sync")
    mark_synced(points, fresh.select("id"), epoch, writer)
    return out


def forget(points: TableStore, gone: DataFrame) -> None:
    """After points were deleted: drop their edges, and unsync the points whose
    nearest they were.  ``gone`` has their ids in its one column."""
    edges = edge_store(points)
    gone = cut_lineage(gone.toDF("id").distinct(), "deleted_ids")
    orphans = cut_lineage(edges.current().join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).join(gone, "id", "left_anti"), "orphans")
    edges.delete_keys(gone.unionByName(orphans))
    points.replace(points.lookup(orphans).withColumn("sim_sync", F.lit(False)))
