"""Map-reduce, envelope / JSON and reliability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import envelopes as EN
from ..operators import mapreduce as MR
from ..operators import reliability as RL
from ..session import spread
from ..sources.tables import table
from .registry import register

CHUNK = 1000   # orders per chunk (by key range)


@register("chunk_partials", "G8 H9", f"""
SELECT floor(l_orderkey / {CHUNK})::BIGINT AS chunk_id, count(*) AS n, sum(l_quantity * l_quantity) AS partial
FROM lineitem GROUP BY 1""")
def q_chunk_partials(spark, sf):
    return MR.chunk_partials(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_quantity"), CHUNK)


@register("sum_squares", "G7", "SELECT sum(l_quantity * l_quantity) AS total, count(*) AS n FROM lineitem")
def q_sum_squares(spark, sf):
    return MR.sum_of_squares(table(spark, sf, "lineitem"), F.col("l_quantity"))


@register("chain_score", "G9 K7", """
SELECT l_returnflag, avg(l_quantity * 2) AS mean, avg(l_quantity * 2) / 10 AS score FROM lineitem GROUP BY 1""")
def q_chain_score(spark, sf):
    li = table(spark, sf, "lineitem")
    return MR.chain(
        li.select("l_returnflag", "l_quantity"),
        lambda d: d.withColumn("x", F.col("l_quantity") * 2),
        lambda d: d.groupBy("l_returnflag").agg(F.avg("x").alias("mean")),
        lambda d: d.withColumn("score", F.col("mean") / 10))


# ----------------------------------------------------------- envelopes

def _request(spark, sf):
    """One request body per event, its form chosen by the event type."""
    ev = spread(table(spark, sf, "events"), "event_id")
    b64 = EN.b64_encode(F.col("props"))
    et = F.col("event_type")
    body = (F.when(et == "view", F.concat(F.lit("  "), b64, F.lit("\n")))
            .when(et == "click", F.to_json(F.struct(b64.alias("b64"))))
            .when(et == "signup", F.to_json(F.struct(b64.alias("body_b64"))))
            .when(et == "error", F.to_json(F.struct(F.col("user_id").alias("other"))))
            .otherwise(F.concat(F.lit("!"), b64)))
    return ev.select("event_id", body.alias("raw"))


REQUEST_SQL = """
SELECT event_id, CASE
  WHEN event_type = 'view' THEN '  ' || to_base64(encode(props)) || chr(10)
  WHEN event_type = 'click' THEN '{"b64":"' || to_base64(encode(props)) || '"}'
  WHEN event_type = 'signup' THEN '{"body_b64":"' || to_base64(encode(props)) || '"}'
  WHEN event_type = 'error' THEN '{"other":' || user_id::VARCHAR || '}'
  ELSE '!' || to_base64(encode(props)) END AS raw
FROM events"""


def _b64_ok_sql(x: str) -> str:
    return f"(regexp_full_match({x}, '[A-Za-z0-9+/]*={{0,2}}') AND length({x}) % 4 = 0)"


@register("envelope_decode", "J1 J2", f"""
WITH r AS ({REQUEST_SQL}),
j AS (SELECT event_id, raw, CASE WHEN json_valid(raw) THEN raw END AS js FROM r),
c AS (SELECT event_id, js IS NOT NULL AS is_json,
             CASE WHEN coalesce(json_extract_string(js, '$.b64'), '') <> '' THEN json_extract_string(js, '$.b64')
                  ELSE json_extract_string(js, '$.body_b64') END AS b64, raw FROM j),
d AS (SELECT event_id, is_json AND coalesce(b64, '') = '' AS missing,
             CASE WHEN is_json THEN b64 ELSE trim(raw, ' ' || chr(9) || chr(10) || chr(13)) END AS cand FROM c)
SELECT event_id,
  CASE WHEN missing THEN 400 WHEN {_b64_ok_sql('cand')} THEN 200 ELSE 400 END AS status_code,
  CASE WHEN NOT missing AND {_b64_ok_sql('cand')} THEN decode(from_base64(cand)) END AS body,
  CASE WHEN missing THEN 'JSON must contain ''b64'' or ''body_b64'' string'
       WHEN NOT {_b64_ok_sql('cand')} THEN 'Invalid base64 body' END AS error
FROM d""")
def q_envelope_decode(spark, sf):
    r = _request(spark, sf)
    u = EN.unwrap(F.col("raw"))
    return r.select("event_id", u["status_code"].alias("status_code"), EN.as_text(u["body"]).alias("body"),
                    u["error"].alias("error"))


@register("envelope_build", "J3 J1", """
SELECT event_id, '{"status_code":' || (CASE WHEN event_type = 'error' THEN 502 ELSE 200 END)::VARCHAR
  || ',"headers":{"content-type":"application/json"},"body_b64":"' || to_base64(encode(props)) || '"}' AS envelope
FROM events""")
def q_envelope_build(spark, sf):
    ev = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", F.lit(502)).otherwise(F.lit(200))
    headers = F.create_map(F.lit("content-type"), F.lit("application/json"))
    return ev.select("event_id", EN.build(status, headers, EN.b64_encode(F.col("props"))).alias("envelope"))


def _noisy(spark, sf):
    ev = spread(table(spark, sf, "events"), "event_id")
    tail = F.when(F.col("value") > 50, F.lit("done")).otherwise(F.lit(""))
    text = F.concat(F.lit("job "), F.col("event_id").cast("string"), F.lit(" started\n"), F.col("props"),
                    F.lit("\n"), tail)
    whole = F.when(F.col("event_type") == "view", F.col("props")).otherwise(text)
    return ev.select("event_id", whole.alias("stdout"))


@register("last_json_line", "J4", """
WITH n AS (SELECT event_id, CASE WHEN event_type = 'view' THEN props
             ELSE 'job ' || event_id::VARCHAR || ' started' || chr(10) || props || chr(10)
                  || CASE WHEN value > 50 THEN 'done' ELSE '' END END AS stdout FROM events),
l AS (SELECT event_id, unnest(string_split(stdout, chr(10))) AS line, generate_subscripts(string_split(stdout, chr(10)), 1) AS pos FROM n),
best AS (SELECT event_id, arg_max(trim(line), pos) AS line FROM l
         WHERE trim(line) <> '' AND json_valid(trim(line)) GROUP BY event_id)
SELECT n.event_id, CASE WHEN json_valid(n.stdout) THEN n.stdout ELSE best.line END AS json
FROM n LEFT JOIN best USING (event_id)""")
def q_last_json_line(spark, sf):
    n = _noisy(spark, sf)
    return n.select("event_id", EN.last_json_line(F.col("stdout")).alias("json"))


def _headers():
    return F.create_map(
        F.lit("Content-Type"), F.lit("application/json"),
        F.lit("Connection"), F.lit("keep-alive"),
        F.lit("X-User"), F.col("user_id").cast("string"),
        F.lit("Authorization"), F.lit("Bearer abc"),
        F.when(F.col("event_type") == "click", F.lit("TE")).otherwise(F.lit("Cache-Control")),
        F.lit("trailers"))


@register("header_filter", "J5", """
WITH h AS (SELECT event_id, MAP {'Content-Type': 'application/json', 'Connection': 'keep-alive',
             'X-User': user_id::VARCHAR, 'Authorization': 'Bearer abc',
             (CASE WHEN event_type = 'click' THEN 'TE' ELSE 'Cache-Control' END): 'trailers'} AS m FROM events)
SELECT event_id,
  array_to_string(list_sort(list_filter(map_keys(m), lambda k: lower(k) NOT IN
    ('connection', 'keep-alive', 'proxy-authenticate', 'proxy-authorization', 'te', 'trailers',
     'transfer-encoding', 'upgrade', 'host', 'authorization'))), ',') AS request_headers,
  array_to_string(list_sort(list_filter(map_keys(m), lambda k: lower(k) IN ('content-type', 'cache-control'))), ',')
    AS response_headers
FROM h""")
def q_header_filter(spark, sf):
    ev = table(spark, sf, "events").select("event_id", _headers().alias("h"))
    req = F.array_join(F.array_sort(F.map_keys(EN.filter_request_headers(F.col("h")))), ",")
    resp = F.array_join(F.array_sort(F.map_keys(EN.passthrough_headers(F.col("h")))), ",")
    return ev.select("event_id", req.alias("request_headers"), resp.alias("response_headers"))


def _recipe_json():
    et = F.col("event_type")
    name = F.when(et == "error", F.lit("")).otherwise(
        F.concat(F.lit('"recipe_name":"r'), F.col("event_id").cast("string"), F.lit('",')))
    prep = F.when(et == "view", F.lit("")).otherwise(
        F.concat(F.lit('"prep_time_minutes":'), F.pmod("event_id", F.lit(60)).cast("string"), F.lit(",")))
    ingr = F.concat(F.lit('"ingredients":[{"name":"'), et, F.lit('","quantity":"'),
                    F.col("user_id").cast("string"), F.lit(' g"}],'))
    return F.concat(F.lit("{"), name, prep, ingr, F.lit('"instructions":["mix","bake"]}'))


@register("parse_structured", "J6", """
WITH j AS (SELECT event_id, '{' || CASE WHEN event_type = 'error' THEN '' ELSE '"recipe_name":"r' || event_id::VARCHAR || '",' END
  || CASE WHEN event_type = 'view' THEN '' ELSE '"prep_time_minutes":' || (event_id % 60)::VARCHAR || ',' END
  || '"ingredients":[{"name":"' || event_type || '","quantity":"' || user_id::VARCHAR || ' g"}],'
  || '"instructions":["mix","bake"]}' AS s FROM events)
SELECT event_id, json_extract_string(s, '$.recipe_name') AS recipe_name,
  json_extract(s, '$.prep_time_minutes')::INTEGER AS prep_time_minutes,
  json_extract_string(s, '$.ingredients[0].name') AS first_ingredient,
  json_array_length(s, '$.instructions')::INTEGER AS n_instructions,
  json_extract_string(s, '$.recipe_name') IS NOT NULL AS valid
FROM j""")
def q_parse_structured(spark, sf):
    ev = table(spark, sf, "events").select("event_id", _recipe_json().alias("s"))
    p = EN.parse_recipe(F.col("s"))
    return ev.select("event_id", p["r"]["recipe_name"].alias("recipe_name"),
                     p["r"]["prep_time_minutes"].alias("prep_time_minutes"),
                     p["r"]["ingredients"][0]["name"].alias("first_ingredient"),
                     F.size(p["r"]["instructions"]).alias("n_instructions"), p["valid"].alias("valid"))


def _call_args():
    et = F.col("event_type")
    temp = (F.when(et == "view", "daylight").when(et == "click", "cool").when(et == "signup", "warm")
            .when(et == "error", "hot").otherwise("cool"))
    return F.create_map(F.lit("brightness"), F.round("value").cast("bigint").cast("string"),
                        F.lit("color_temp"), temp)


CALL_SQL = """
SELECT event_id, round(value)::BIGINT::VARCHAR AS brightness,
  CASE event_type WHEN 'view' THEN 'daylight' WHEN 'click' THEN 'cool' WHEN 'signup' THEN 'warm'
                  WHEN 'error' THEN 'hot' ELSE 'cool' END AS color_temp FROM events"""


@register("format_call", "J7", f"""
SELECT event_id, 'set_light_values(brightness=' || brightness || ', color_temp=' || color_temp || ')' AS call
FROM ({CALL_SQL})""")
def q_format_call(spark, sf):
    ev = table(spark, sf, "events").select("event_id", _call_args().alias("args"))
    return ev.select("event_id", EN.format_call(F.lit("set_light_values"), F.col("args")).alias("call"))


@register("check_arguments", "J8", f"""
SELECT event_id,
  array_to_string(list_filter([
    CASE WHEN brightness::INTEGER < 0 OR brightness::INTEGER > 100 THEN 'brightness out of range' END,
    CASE WHEN color_temp NOT IN ('daylight', 'cool', 'warm') THEN 'color_temp not allowed' END],
    lambda x: x IS NOT NULL), '; ') AS violations
FROM ({CALL_SQL})""")
def q_check_arguments(spark, sf):
    ev = table(spark, sf, "events").select("event_id", _call_args().alias("args"))
    v = EN.check_args(F.col("args"), ["brightness", "color_temp"], {"brightness": (0, 100)},
                      {"color_temp": ["daylight", "cool", "warm"]})
    return ev.select("event_id", F.array_join(v, "; ").alias("violations"))


@register("conversation_history", "J9", """
SELECT conv_id, turn, 'role - ' || role || ': ' || text AS line FROM conversations ORDER BY conv_id, turn, line""")
def q_conversation_history(spark, sf):
    c = table(spark, sf, "conversations")
    # One listing line per turn, in the order of conversation and turn (a range
    # partition by that order); a conversation is never gathered into one value.
    return c.select("conv_id", "turn", EN.history_line(F.col("role"), F.col("text")).alias("line")).orderBy("conv_id", "turn", "line")


# ----------------------------------------------------------- reliability

@register("skip_done", "K4 F2", """
WITH mid AS (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 AS m FROM events),
done AS (SELECT event_id FROM events WHERE epoch_us(ts) < (SELECT m FROM mid))
SELECT e.event_id, CASE WHEN d.event_id IS NULL THEN 'ok' ELSE 'already_done' END AS status
FROM events e LEFT JOIN done d USING (event_id)""")
def q_skip_done(spark, sf):
    ev = table(spark, sf, "events")
    return RL.skip_done(ev, RL.first_half_done(ev), "event_id").select("event_id", "status")


@register("ok_error_rows", "K5", """
SELECT event_id, (json_extract(props, '$.k')::BIGINT % 10) <> 0 AS ok,
  CASE WHEN (json_extract(props, '$.k')::BIGINT % 10) <> 0
       THEN round(value / (json_extract(props, '$.k')::BIGINT % 10), 6) END AS result,
  CASE WHEN (json_extract(props, '$.k')::BIGINT % 10) = 0 THEN 'division by zero' END AS error
FROM events""")
def q_ok_error_rows(spark, sf):
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint") % 10
    r = RL.safe_divide(F.col("value"), k)
    return ev.select("event_id", r["ok"].alias("ok"), F.round(r["value"], 6).alias("result"),
                     r["error"].alias("error"))


@register("attempt_cap", "K6", """
SELECT event_id, CASE WHEN k % 10 <> 0 THEN 'good' WHEN event_id % 5 < 3 THEN 'retry' ELSE 'rejected' END AS route,
  CASE WHEN k % 10 = 0 AND event_id % 5 < 3 THEN event_id % 5 + 1 END AS next_attempt
FROM (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events)""")
def q_attempt_cap(spark, sf):
    ev = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    tried = F.pmod("event_id", F.lit(5))
    return RL.route_attempts(ev, F.col("k") % 10 != 0, tried, 3).select("event_id", "route", "next_attempt")


@register("dead_letter", "K6", """
SELECT event_id, CASE WHEN (json_extract(props, '$.k')::BIGINT % 10) = 0 THEN 'dead_letter' ELSE 'good' END AS route
FROM events""")
def q_dead_letter(spark, sf):
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint") % 10
    r = RL.safe_divide(F.col("value"), k)
    good, bad = RL.route(ev.withColumn("r", r), F.col("r.ok"))
    return good.select("event_id", F.lit("good").alias("route")).unionByName(
        bad.select("event_id", F.lit("dead_letter").alias("route")))
