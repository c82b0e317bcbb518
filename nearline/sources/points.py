"""Point records derived from ``events``: promoted columns plus a VARIANT payload.

Each event becomes one point.  The payload exercises the three kinds of
nothing the filter language distinguishes, decided by the event's own
values (not by sampling): ``note`` is absent for views, JSON null for
clicks and a string otherwise; ``tags`` is ``[]`` for sign-ups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import LOG_LINES_SQL, log_text, pod_name, table


def _payload_json():
    et = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    note = (F.when(et == "view", F.lit(""))
            .when(et == "click", F.lit(',"note":null'))
            .otherwise(F.concat(F.lit(',"note":"v='), F.col("value").cast("string"), F.lit('"'))))
    tags = F.when(et == "signup", F.lit("[]")).otherwise(
        F.concat(F.lit('["'), et, F.lit('","user'), F.col("user_id").cast("string"), F.lit('"]')))
    return F.concat(F.lit('{"k":'), k, note, F.lit(',"tags":'), tags, F.lit("}"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, severity, pod_name, text_payload, ts, value, user_id, payload VARIANT, payload_json)``."""
    pj = _payload_json()
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.upper("event_type").alias("severity"), pod_name().alias("pod_name"),
        log_text().alias("text_payload"), "ts", "value", "user_id", F.parse_json(pj).alias("payload"), pj.alias("payload_json"))


EVENT_POINTS_SQL = f"""
SELECT e.event_id AS id, upper(e.event_type) AS severity, l.pod_name, l.text AS text_payload, e.ts, e.value, e.user_id,
  '{{"k":' || json_extract_string(e.props, '$.k')
  || CASE WHEN e.event_type = 'view' THEN '' WHEN e.event_type = 'click' THEN ',"note":null'
          ELSE ',"note":"v=' || e.value::VARCHAR || '"' END
  || ',"tags":' || CASE WHEN e.event_type = 'signup' THEN '[]'
          ELSE '["' || e.event_type || '","user' || e.user_id::VARCHAR || '"]' END
  || '}}' AS payload_json
FROM events e JOIN ({LOG_LINES_SQL}) l ON l.log_id = e.event_id
"""
