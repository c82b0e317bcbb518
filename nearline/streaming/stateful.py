"""Records seen before, kept as keyed state of a stream (K1, K4).

:func:`first_seen` passes a record on when its id comes for the first time and
drops it when it comes again.  The ids are the state of an
``applyInPandasWithState`` operator, kept in the stream's checkpoint and
partitioned by id; a batch touches the state of its own ids only.  A timeout per
id forgets it when it has not come for ``ttl`` (any batch may then have work, so
such a stream runs on until it is stopped); without a ``ttl`` ids are kept for
good, and a run ends when all that is there is read.  Within a batch the record with the smallest time, then
text, stands for its id.

:func:`stream_ingest_once` puts the ingest gate behind it, in place of the gate's
own look-up of seen ids in the lookup table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def first_seen(stream: DataFrame, id_col: str, order: list[str], ttl_ms: int | None = None) -> DataFrame:
    """The records of a stream whose id comes for the first time (within ``ttl_ms``
    of its last coming)."""
    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        came = pd.concat(list(frames), ignore_index=True)
        known = state.exists
        state.update(((state.get[0] if known else 0) + len(came),))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        if not known:
            yield came.sort_values(order, kind="stable").head(1)

    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(id_col).applyInPandasWithState(run, stream.schema, "times long", "append", timeout)


def stream_ingest_once(stream: DataFrame, points, lookup, cfg, checkpoint: str, ttl_ms: int | None = None):
    """K1 and K4 on a stream ``(text, pod_name, severity, ts)``: records seen before
    are dropped by keyed state, the others are gated batch by batch."""
    from .ingest import log_id, stream_ingest
    logs = stream.select("text", "pod_name", "severity", "ts", log_id(F.col("text"), F.col("pod_name"), F.col("severity")).alias("log_id"))
    return stream_ingest(first_seen(logs, "log_id", ["ts", "text"], ttl_ms).drop("log_id"), points, lookup, cfg, checkpoint,
                         trigger_available_now=ttl_ms is None)
