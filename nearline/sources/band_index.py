"""Band index of a point store: which stored signatures share a band with a new one.

Two tables of the store's own kind stand beside the points:

* ``bands``: ``(bk, key)``, one row per band hash and distinct signature, in
  slots by a hash of the band;
* ``members``: one row per point with its signature's key, the signature and
  its band hashes, in slots by a hash of that key.

Both are compacted like any table.  The index is derived from the points' log
and nothing else: :meth:`BandIndex.catch_up` indexes the writes that it hasn't
seen, deletions among them, each under its own place in the points' log, so a
repeated call adds nothing and a lost one is made up for by the next.

A match asks for the bands of the new signatures: of the segments, only the
slots of these bands, then only the slots of the keys found there are opened.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import is_small, spread_join
from ..operators.tiles import best_matches
from ..session import cut_lineage
from .store import TableStore

BANDS = T.StructType([T.StructField("entry", T.StringType()), T.StructField("bk", T.LongType()), T.StructField("key", T.StringType())])
MEMBERS = T.StructType([T.StructField("id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("signature", T.ArrayType(T.LongType())),
                        T.StructField("bands", T.ArrayType(T.LongType()))])


def signature_key(sig: Column) -> Column:
    """128 bits of hash that name a signature."""
    return F.concat(F.hex(F.xxhash64(sig)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), sig)))


def band_hashes(band_keys: Column) -> Column:
    return F.transform(band_keys, lambda k: F.xxhash64(k))


def similarity_blocks(metric: str):
    """One signature against a block of them, as the Column expressions score them."""
    def cosine(a, block):
        a, block = a.astype(np.float64), block.astype(np.float64)
        den = np.sqrt((a * a).sum()) * np.sqrt((block * block).sum(axis=1))
        return np.where(den == 0, 0.0, block @ a / np.where(den == 0, 1.0, den))

    def jaccard(a, block):
        return (block == a[None, :]).sum(axis=1) / block.shape[1]

    jaccard.equal_places = True

    def dot(a, block):
        return block.astype(np.float64) @ a.astype(np.float64)

    known = {"cosine": cosine, "dot": dot, "jaccard": jaccard}
    if metric not in known:
        raise ValueError(f"a similarity is one of {sorted(known)}, not {metric!r}")
    return known[metric]


def keyed(points: DataFrame) -> DataFrame:
    """``(id, key, signature, bands)`` of points."""
    key = F.col("key") if "key" in points.columns else signature_key(F.col("signature"))
    return points.select("id", key.alias("key"), "signature", band_hashes(F.col("band_keys")).alias("bands"))


def distinct_signatures(points: DataFrame) -> DataFrame:
    """``(key, id, signature, bands)``: one row per signature with its smallest id."""
    return whole_rows(k := keyed(points), first_ids(k))


def first_ids(members: DataFrame) -> DataFrame:
    """``(key, id)``: the smallest id of every key, written."""
    return cut_lineage(members.groupBy("key").agg(F.min("id").alias("id")), "first_ids")


def whole_rows(members: DataFrame, first: DataFrame) -> DataFrame:
    """``(key, id, signature, bands)`` of the ``first`` ids.  Where they are few
    (lines repeat) they are broadcast: no signature is sorted or shuffled but theirs."""
    if is_small(first):
        return members.join(F.broadcast(first), ["key", "id"], "left_semi").select("key", "id", "signature", "bands").dropDuplicates(["key"])
    return members.groupBy("key").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))


def band_rows(signatures: DataFrame) -> DataFrame:
    return signatures.select(F.explode(F.array_distinct("bands")).alias("bk"), "key")


class BandIndex:
    def __init__(self, spark: SparkSession, root: str, compact_every: int = 8):
        self.bands = TableStore(spark, root + "/bands", BANDS, "entry", "first_wins", slot_by="bk", compact_every=compact_every)
        self.members = TableStore(spark, root + "/members", MEMBERS, "id", "last_wins", slot_by="key", compact_every=compact_every)

    def reaches(self, place: int) -> bool:
        """True where the index holds a write at or after ``place``."""
        return self.members.next_epoch("points") > place

    def catch_up(self, points: TableStore, before: int) -> None:
        """Index the points' writes below a place that are not in yet."""
        for seq, rows in points.writes(before, lambda seq: not self.members.is_written(seq, "points")):
            gone = F.coalesce("__deleted", F.lit(False))
            live = keyed(rows.where(~gone))
            one = whole_rows(live, first_ids(live))
            entries = band_rows(one).select(F.concat_ws(":", F.col("bk").cast("string"), "key").alias("entry"), "bk", "key")
            self.bands.insert_if_absent(entries, seq, "points", distinct=True)
            # Last: a member written is a write indexed whole.
            self.members.put(live.withColumn("__deleted", F.lit(False)).unionByName(keyed(rows.where(gone)).withColumn("__deleted", F.lit(True))),
                             seq, "points")

    def match(self, new: DataFrame, metric: str) -> DataFrame:
        """``(key, match_id, similarity)``: the best stored point of every new
        signature ``(key, signature, bands)``, among all that share a band."""
        asked = cut_lineage(band_rows(new), "asked_bands")
        entries = cut_lineage(self.bands.lookup(asked.select("bk"), on="bk").select("bk", "key"), "stored_bands")
        found = self.members.lookup(entries.select("key"), on="key")
        old = whole_rows(found, first_ids(found))
        return best_matches(new, cut_lineage(old, "stored_signatures"), asked, entries, similarity_blocks(metric))


def match_view(new: DataFrame, stored: DataFrame, metric: str) -> DataFrame:
    """The same from a view of the points itself, without an index."""
    old = cut_lineage(distinct_signatures(stored), "stored_signatures")
    return best_matches(new, old, band_rows(new), cut_lineage(band_rows(old), "stored_bands"), similarity_blocks(metric))


def best_of_ids(incoming: DataFrame, best: DataFrame) -> DataFrame:
    """``(id, match_id, similarity)`` from the matches of the signatures; one
    signature may stand for any share of the batch."""
    per_id = incoming.select("id", signature_key(F.col("signature")).alias("key")).dropDuplicates(["id"])
    return spread_join(per_id, cut_lineage(best, "best_matches"), ["key"], "inner", salt_by=["id"]).select("id", "match_id", "similarity")
