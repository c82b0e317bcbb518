"""Near-duplicate ingest gate, batch and Structured Streaming.

Per batch: embed the incoming logs once, match each against the store as
it was *before* the batch, decide, then write the store (points, last wins)
and the lookup table (first wins).  Both writes are named by (writer, epoch) and
have a fixed place in the stores' logs, so a replayed micro-batch sees the
store as its first run did and changes nothing.

Matching (F1, k=1) finds the best of *all* stored points that share a band with
the incoming log, scored with the configured metric, ties to the smaller id.
The stored side comes from the band index beside the points
(:mod:`nearline.sources.band_index`): only the slots of the batch's bands are
opened, and new and stored signatures meet in tiles.  A batch whose place
lies before writes that are indexed already (an old one, repeated) is matched
against the view of the points at that place instead, with the same result.
``cosine`` of raw signatures is the faithful default; ``jaccard`` (share of
equal signature slots) is offered as the better-behaved choice.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import minhash as M
from ..operators.embedders import Embedder, MinHashEmbedder
from ..operators.skew import is_small, salted_join, spread_join
from ..session import cut_lineage
from ..sources.band_index import BandIndex, best_of_ids, distinct_signatures, keyed, match_view, signature_key, similarity_blocks
from ..sources.store import OWN, TableStore


@dataclass(frozen=True)
class GateConfig:
    params: M.MinHashParams = field(default_factory=lambda: M.MinHashParams(5, 128, 32, 123))
    threshold: float = 0.8
    metric: str = "cosine"              # "cosine" (faithful), "dot" or "jaccard"
    dedupe_within_batch: bool = False
    embedder: Embedder | None = None    # None: MinHash of ``params``, scored by ``metric``

    def __post_init__(self):
        if self.embedder is not None:   # its own distance scores
            object.__setattr__(self, "metric", self.embedder.distance)
        elif self.params.hash == "md5":
            object.__setattr__(self, "embedder", MinHashEmbedder(self.params, self.metric))


def log_id(text, pod_name, severity):
    """Content id of a log record (canonical JSON metadata)."""
    return F.md5(F.concat_ws("-", text, F.to_json(F.struct(pod_name.alias("pod_name"),
                                                           severity.alias("severity")))))


def embed_logs(logs: DataFrame, cfg: GateConfig, seen: DataFrame | None = None) -> DataFrame:
    """``logs(text, pod_name, severity, ts)`` -> points rows with id, signature, band
    keys; ids in the one column of ``seen`` (written) are left out before they are embedded."""
    with_id = logs.withColumn("id", log_id(F.col("text"), F.col("pod_name"), F.col("severity")))
    if seen is not None:
        with_id = with_id.join(F.broadcast(seen) if is_small(seen) else seen, "id", "left_anti")
    p = cfg.params
    if cfg.embedder is not None:
        emb = cfg.embedder.embeds(with_id, "text")      # in place: no join, no shuffle
    else:
        sig = M.signatures(with_id.select("id", "text").dropDuplicates(["id"]), "id", "text", p)
        emb = with_id.join(sig, "id")
    return emb.select("id", "signature", "band_keys", F.col("text").alias("text_payload"), "pod_name",
                      "severity", F.col("ts").cast("timestamp").alias("ts"))


def match(incoming: DataFrame, stored: DataFrame, metric: str) -> DataFrame:
    """``(id, match_id, similarity)``: the best of all stored points that share
    a band, per incoming id (no row if none).  Equal signatures are compared once."""
    return best_of_ids(incoming, match_keys(incoming, stored, metric))


def match_keys(incoming: DataFrame, stored: DataFrame, metric: str) -> DataFrame:
    """:func:`match` by signature: ``(key, match_id, similarity)``."""
    new = cut_lineage(distinct_signatures(incoming).drop("id"), "new_signatures")
    return match_view(new, stored, metric)


def band_index(points: TableStore) -> BandIndex:
    """The index that stands beside a point store."""
    return BandIndex(points.spark, points.root + "-bands")


def match_stored(incoming: DataFrame, points: TableStore, place: int, metric: str) -> DataFrame:
    """:func:`match_keys` against the points as they were before ``place``, written."""
    index = band_index(points)
    if not points.has_writes(place):
        return incoming.sparkSession.createDataFrame([], "key string, match_id string, similarity double")
    if index.reaches(place):
        return cut_lineage(match_keys(incoming, points.current(place).select("id", "signature", "band_keys"), metric), "best_matches")
    index.catch_up(points, place)
    new = cut_lineage(distinct_signatures(incoming).drop("id"), "new_signatures")
    return cut_lineage(index.match(new, metric), "best_matches")


def decide(incoming: DataFrame, best: DataFrame, threshold: float) -> DataFrame:
    """K1/K2: ``decision`` = duplicate (lookup row only) or new (stored; self lookup row).
    Equal signatures have one match, so ``best`` is joined by their key."""
    j = spread_join(incoming, best, ["key"], "left", salt_by=["id"]).drop("key")
    dup = F.coalesce(F.col("similarity") >= F.lit(threshold), F.lit(False))
    return j.select("*", F.when(dup, F.lit("duplicate")).otherwise(F.lit("new")).alias("decision"),
                    F.when(dup, F.col("match_id")).otherwise(F.col("id")).alias("closest_log_id"),
                    F.when(dup, F.col("similarity")).otherwise(F.lit(1.0)).alias("lookup_sim"))


def ingest(logs: DataFrame, points: TableStore, lookup: TableStore, cfg: GateConfig,
           epoch: int | None = None, writer: str = OWN, skip_seen: bool = False) -> DataFrame:
    """K1: gate one batch; returns the materialised decisions of the batch.

    ``skip_seen`` (K4): records whose id the lookup table held before this
    batch are left out.  Seen ids are looked up in the table, so a record may
    come back at any time.
    """
    epoch = points.next_epoch(writer) if epoch is None else epoch
    place, look_place = points.place(writer, epoch), lookup.place(writer, epoch)
    name = f"{writer}-{epoch}"
    similarity_blocks(cfg.metric)                                 # refuse an unknown metric before any work
    if points.is_settled(place):                                  # merged long ago: nothing is written, the answer is on record
        return settled_decisions(embed_logs(logs, cfg), lookup)
    seen = None
    if skip_seen and lookup.has_writes(look_place):               # an empty table's size is unknown to Spark: texts would be shuffled
        seen = cut_lineage(lookup.log(look_place).select("id").distinct(), "seen_ids")
    rows = embed_logs(logs, cfg, seen)
    # Embedded once: matching, deciding and both writes read it.
    incoming = cut_lineage(rows.withColumn("key", signature_key(F.col("signature"))), f"embedded-{name}")
    # Both are written before the store moves, so the decisions are fixed.
    decisions = decide(incoming, match_stored(incoming, points, place, cfg.metric), cfg.threshold)
    if cfg.dedupe_within_batch:
        # Only among the rows that would be stored: the first of equal ones is.
        new = F.col("decision") == "new"
        first = decisions.where(new).groupBy("signature").agg(F.min("id").alias("__first"))
        twin = new & (F.col("id") != F.col("__first"))
        decisions = salted_join(decisions, first, ["signature"], "left", salt_by=["id"]).withColumns({
            "closest_log_id": F.when(twin, F.col("__first")).otherwise(F.col("closest_log_id")),
            "decision": F.when(twin, F.lit("duplicate")).otherwise(F.col("decision"))}).drop("__first")
        decisions = cut_lineage(decisions, f"ingest-{name}")
    new_points = decisions.where(F.col("decision") == "new").select(
        "id", "signature", "band_keys", "text_payload", "pod_name", "severity", "ts",
        F.lit(False).alias("sim_sync"), F.current_timestamp().alias("insert_ts"))
    points.upsert(new_points, epoch, writer)
    lookup.insert_if_absent(decisions.select(
        "id", "closest_log_id", F.col("lookup_sim").alias("similarity"), F.col("ts").alias("timestamp"),
        F.col("pod_name").alias("location")), epoch, writer)
    return decisions


def settled_decisions(rows: DataFrame, lookup: TableStore) -> DataFrame:
    """The decisions of a batch whose writes are merged, from its lookup rows."""
    found = lookup.lookup(rows.select("id")).select("id", "closest_log_id", F.col("similarity").alias("lookup_sim"))
    own = F.col("closest_log_id") == F.col("id")
    return rows.join(found, "id").withColumns({
        "decision": F.when(own, F.lit("new")).otherwise(F.lit("duplicate")),
        "match_id": F.when(~own, F.col("closest_log_id")), "similarity": F.when(~own, F.col("lookup_sim"))})


def summary(decisions: DataFrame) -> DataFrame:
    """Counts per decision."""
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def sync_edges(points: TableStore, metric: str = "cosine") -> DataFrame:
    """K3 as a plain scan: ``(src, dst, sim)`` from every unsynced point to its
    nearest other *unsynced* point, the best of all that share a band.
    :func:`nearline.streaming.neighbours.sync` keeps the edges of all points up."""
    from .neighbours import nearest_edges
    return nearest_edges(keyed(points.current().where(~F.coalesce("sim_sync", F.lit(False)))), metric)


def mark_synced(points: TableStore, ids: DataFrame, epoch: int | None = None, writer: str = OWN) -> int:
    """K3 completion: set ``sim_sync`` for the given ids (A13 on the store)."""
    epoch = points.next_epoch(writer) if epoch is None else epoch
    cur = points.lookup(ids.select("id"), points.place(writer, epoch))
    return points.replace(cur.withColumn("sim_sync", F.lit(True)), epoch, writer)


def stream_ingest(stream: DataFrame, points: TableStore, lookup: TableStore, cfg: GateConfig,
                  checkpoint: str, trigger_available_now: bool = True, skip_seen: bool = False):
    """K1 on a stream: ``foreachBatch`` runs :func:`ingest` with the micro-batch
    number, under a writer's name made from the checkpoint's path.

    ``skip_seen`` (K4): see :func:`ingest`.  No watermark is set, so a row
    that comes late is gated like any other.
    """
    writer = "stream-" + hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def run(batch: DataFrame, epoch: int) -> None:
        ingest(batch, points, lookup, cfg, epoch, writer, skip_seen)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()
