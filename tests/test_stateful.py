"""Keyed state on a stream against the batch gate."""

import uuid

from pyspark.sql import functions as F

from nearline.operators import minhash as M
from nearline.session import ensure_checkpoint_dir
from nearline.sources import store as S
from nearline.streaming import ingest as IG
from nearline.streaming import stateful as ST


def rows(st):
    return sorted(tuple(r) for r in st.current().select("id", "closest_log_id", F.round("similarity", 6)).collect())


def test_two_batches_equal_the_batch_gate_and_a_restart_changes_nothing(spark, logs):
    base = f"{ensure_checkpoint_dir(spark)}/tws-{uuid.uuid4().hex}"
    src = logs.select("n", "text", "pod_name", "severity", F.to_timestamp("timestamp").alias("ts"))
    cfg = IG.GateConfig(M.MinHashParams(5, 64, 16, 7, profile="basic"), 0.8, "jaccard")
    halves = [src.where("n <= 3").drop("n"), src.where("n >= 2").drop("n")]      # records 2 and 3 come twice

    bp, bl = S.point_store(spark, f"{base}/batch"), S.lookup_store(spark, f"{base}/batch")
    for epoch, half in enumerate(halves):
        IG.ingest(half, bp, bl, cfg, epoch, skip_seen=True)

    sp, sl = S.point_store(spark, f"{base}/stream"), S.lookup_store(spark, f"{base}/stream")

    def run():
        stream = spark.readStream.schema(halves[0].schema).parquet(f"{base}/in/*")
        q = ST.stream_ingest_once(stream, sp, sl, cfg, f"{base}/ckpt")
        q.awaitTermination()

    for k, half in enumerate(halves):
        half.unionByName(half).coalesce(1).write.parquet(f"{base}/in/{k}")       # and every record twice within a batch
        run()
    assert rows(sl) == rows(bl) and len(rows(bl)) == 5
    assert sorted(r.id for r in sp.current().collect()) == sorted(r.id for r in bp.current().collect())
    before = sp.next_epoch(), rows(sl)
    run()                                                                        # a restart without new files
    assert rows(sl) == before[1]


def test_ids_are_forgotten_after_their_time(spark):
    """With a ``ttl`` an id that comes again in time is dropped, and passes once it was forgotten."""
    import time
    base = f"{ensure_checkpoint_dir(spark)}/ttl-{uuid.uuid4().hex}"
    name = f"ttl_{uuid.uuid4().hex[:8]}"

    def come(k, rows):
        spark.createDataFrame(rows, "id string, text string").coalesce(1).write.parquet(f"{base}/in/{k}")

    come(0, [("a", "first"), ("b", "first"), ("a", "again")])
    stream = spark.readStream.schema("id string, text string").parquet(f"{base}/in/*")
    q = (ST.first_seen(stream, "id", ["text"], ttl_ms=6000).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", f"{base}/ckpt").trigger(processingTime="500 milliseconds").start())

    def passed(n, seconds=100):
        end = time.time() + seconds
        while time.time() < end and spark.table(name).count() < n:
            time.sleep(0.5)
        return sorted(tuple(r) for r in spark.table(name).collect())

    try:
        assert passed(2) == [("a", "again"), ("b", "first")]
        time.sleep(14)                                                  # longer than the ttl, batches run on
        come(1, [("a", "later")])
        assert passed(3) == [("a", "again"), ("a", "later"), ("b", "first")]
    finally:
        q.stop()
