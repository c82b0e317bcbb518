"""Base64 / JSON envelopes, header maps and structured outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: hop-by-hop header names dropped in both directions, the
# --- headers kept when passing a response through, and the strict base64 alphabet.
HOP_BY_HOP = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailers",
              "transfer-encoding", "upgrade", "host")
PASSTHROUGH = ("content-type", "cache-control")
B64_STRICT = r"^[A-Za-z0-9+/]*={0,2}$"
# --- end of fixed values

RECIPE = T.StructType([
    T.StructField("recipe_name", T.StringType(), True),
    T.StructField("prep_time_minutes", T.IntegerType(), True),
    T.StructField("ingredients", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType(), True),
        T.StructField("quantity", T.StringType(), True)])), True),
    T.StructField("instructions", T.ArrayType(T.StringType()), True),
])


def b64_encode(body: Column) -> Column:
    """J1 encode (UTF-8 text or binary)."""
    return F.base64(body)


def b64_ok(s: Column) -> Column:
    """Strict check: alphabet, padding only at the end, length a multiple of 4."""
    return s.rlike(B64_STRICT) & (F.length(s) % 4 == 0)


def b64_decode(s: Column) -> Column:
    """J1 strict decode to bytes; null when not valid base64."""
    return F.when(b64_ok(s), F.unbase64(s))


def as_text(body: Column) -> Column:
    """UTF-8 text of a body, null where the bytes are no UTF-8."""
    return F.try_validate_utf8(body.cast("string"))


def unwrap(raw: Column) -> Column:
    """``struct(status_code, body BINARY, error)`` for a request body.

    JSON object -> its ``b64`` (else ``body_b64``), which must be a string,
    decoded; JSON without either -> 400; anything else is raw base64 text
    (trimmed).  Bytes of any kind pass; see :func:`as_text`.
    """
    parsed = F.try_parse_json(raw)
    is_json = parsed.isNotNull()

    def string_at(path):
        v = F.try_variant_get(parsed, path, "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(parsed, path, "string"))

    b64_a = string_at("$.b64")
    b64 = F.when(F.coalesce(b64_a, F.lit("")) != "", b64_a).otherwise(string_at("$.body_b64"))
    cand = F.when(is_json, b64).otherwise(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    body = b64_decode(cand)
    missing = is_json & (F.coalesce(b64, F.lit("")) == "")
    status = F.when(missing, F.lit(400)).when(body.isNull(), F.lit(400)).otherwise(F.lit(200))
    err = (F.when(missing, F.lit("JSON must contain 'b64' or 'body_b64' string"))
           .when(body.isNull(), F.lit("Invalid base64 body")))
    return F.struct(status.alias("status_code"), F.when(~missing, body).alias("body"), err.alias("error"))


def build(status: Column, headers: Column, body_b64: Column) -> Column:
    """``{"status_code", "headers", "body_b64"}`` as JSON text."""
    return F.to_json(F.struct(status.alias("status_code"), headers.alias("headers"), body_b64.alias("body_b64")))


def last_json_line(text: Column) -> Column:
    """The whole text if it parses as JSON, else its last parseable non-blank line."""
    lines = F.filter(F.split(text, "\n"), lambda l: (F.trim(l) != "") & F.try_parse_json(F.trim(l)).isNotNull())
    return F.when(F.try_parse_json(text).isNotNull(), text) \
        .otherwise(F.trim(F.try_element_at(lines, F.lit(-1))))


def filter_request_headers(h: Column) -> Column:
    """Drop hop-by-hop headers and any Authorization (names case-insensitive)."""
    drop = list(HOP_BY_HOP) + ["authorization"]
    return F.map_filter(h, lambda k, v: ~F.lower(k).isin(*drop))


def passthrough_headers(h: Column) -> Column:
    """J5 (response side): keep only content-type and cache-control."""
    return F.map_filter(h, lambda k, v: F.lower(k).isin(*PASSTHROUGH))


def parse_recipe(s: Column) -> Column:
    """Typed record; ``valid`` when every required field is present."""
    r = F.from_json(s, RECIPE, {"mode": "PERMISSIVE"})
    return F.struct(r.alias("r"), (r["recipe_name"].isNotNull() & r["ingredients"].isNotNull()
                                   & r["instructions"].isNotNull()).alias("valid"))


def format_call(name: Column, args: Column) -> Column:
    """``name(k=v, k=v)`` in argument order."""
    parts = F.transform(F.map_entries(args), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(name, F.lit("("), F.array_join(parts, ", "), F.lit(")"))


def check_args(args: Column, required: list[str], ints: dict[str, tuple[int, int]],
               enums: dict[str, list[str]]) -> Column:
    """List of violations against a declared argument schema (empty = ok)."""
    checks = []
    for k in required:
        checks.append(F.when(F.element_at(args, k).isNull(), F.lit(f"missing {k}")))
    for k, (lo, hi) in ints.items():
        v = F.element_at(args, k)
        iv = v.try_cast("int")
        checks.append(F.when(v.isNotNull() & (iv.isNull() | ~v.rlike(r"^-?\d+$")), F.lit(f"{k} not an integer"))
                      .when(v.isNotNull() & ((iv < lo) | (iv > hi)), F.lit(f"{k} out of range")))
    for k, allowed in enums.items():
        v = F.element_at(args, k)
        checks.append(F.when(v.isNotNull() & ~v.isin(*allowed), F.lit(f"{k} not allowed")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def history_line(role: Column, text: Column) -> Column:
    """One listing line ``role - {role}: {text}``."""
    return F.concat(F.lit("role - "), role, F.lit(": "), text)


def merge_payload(old: Column, new: Column) -> Column:
    """Map merge, later keys win (old keys not in ``new`` stay)."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)
