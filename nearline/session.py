"""Spark session helpers.

Library code never creates its own session; it takes the caller's.  The
helpers here build a session for tests, the bench and the command line, and
resolve the shared checkpoint folder the cluster names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale as much as locally: adaptive execution
# (runtime coalescing, skew-join splitting), UTC session time, Arrow for the
# few vectorised Python helpers.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "nearline", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults."""
    b = SparkSession.builder.appName(app_name)
    b = b.master(master or os.environ.get("NEARLINE_MASTER", "local[8]"))
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("NEARLINE_DRIVER_MEMORY", "16g"))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when nothing is configured and the master is local (tests, a
    laptop) do we create a fresh scratch folder; elsewhere that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="nearline-ckpt-"))
    return sc.getCheckpointDir()


def is_local(spark: SparkSession) -> bool:
    """One process (``local[...]``), whose temporary folder every task sees."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder.

    Iterative and fan-out operators call this so that later stages (and a
    re-run after a lost executor) read the written table instead of
    replaying the lineage.  One job computes and writes the rows;
    ``Dataset.checkpoint`` would compute them twice (once for the action,
    once for the checkpoint write) unless they were cached first.
    """
    root = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, *cols: str, part_bytes: int | None = None) -> DataFrame:
    """Hash-partition a table that scans in fewer splits than the cluster has cores.

    For the readers of a query: CPU-heavy per-row work (regex masking, n-gram
    hashing) should use every core, and a small table stored as one row group
    scans as one task.  Splits follow the bytes, so a table of few but large
    files is left alone.  Only the scan is planned, no stage runs.
    ``part_bytes``: one partition per so many bytes of the scan at least, so
    tasks stay short however large the table is.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if part_bytes:
        target = max(target, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // part_bytes)
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= target:
        return df
    return df.repartition(target, *cols) if cols else df.repartition(target)
