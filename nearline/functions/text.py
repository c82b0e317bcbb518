"""Text normalisation: masking of volatile parts of a log line.

Every rule is a JVM ``regexp_replace`` applied in a fixed order; each rule
sees the output of the former ones.  The same rule tables also render the
equivalent DuckDB SQL, which the correctness oracle runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str          # Python/Java/RE2 common syntax
    replacement: str      # "$1"-style group references
    ignore_case: bool = False
    lookahead: bool = False   # RE2 (DuckDB) cannot run it


# --- Fixed values: these patterns, tokens and their order must equal the
# --- reference's for identical normalised text.  Listed in application order.

# "full" profile (the production normaliser).
FULL_RULES: tuple[Rule, ...] = (
    Rule("url", r"\bhttps?://[^\s\"'<>]+", "<url>", ignore_case=True),
    Rule("email", r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", "<url>", ignore_case=True),
    Rule("arn", r"\barn:aws[a-z-]*:[a-z0-9-]+:[a-z0-9-]*:\d{12}:[^\s\"']+\b", "<url>", ignore_case=True),
    Rule("jwt", r"\beyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b", "<url>"),
    Rule("uuid", r"\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<id>", ignore_case=True),
    Rule("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", "<ip>"),
    Rule("ipv6", r"\b(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}\b", "<ip>", ignore_case=True),
    Rule("mac", r"\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b", "<ip>", ignore_case=True),
    Rule("ts_iso", r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:\d{2})?\b", "<ts>", ignore_case=True),
    Rule("ts_date", r"\b\d{4}/\d{2}/\d{2}\b", "<ts>"),
    Rule("ts_time", r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "<ts>"),
    Rule("kv_id",
         r"\b(trace[_-]?id|span[_-]?id|request[_-]?id|req[_-]?id|correlation[_-]?id|"
         r"session[_-]?id|event[_-]?id|message[_-]?id|msg[_-]?id|job[_-]?id|task[_-]?id|"
         r"txn[_-]?id|transaction[_-]?id|op[_-]?id|operation[_-]?id|run[_-]?id|"
         r"uid|user[_-]?id|account[_-]?id|customer[_-]?id|tenant[_-]?id|org[_-]?id"
         r")\s*([=:])\s*([A-Za-z0-9._:/+=-]{6,})\b",
         "$1$2<id>", ignore_case=True),
    Rule("hex_word", r"\b0x[0-9a-f]+\b", "<hex>", ignore_case=True),
    Rule("hex_long", r"\b[0-9a-f]{16,}\b", "<hex>", ignore_case=True),
    Rule("base64", r"\b(?:[A-Za-z0-9+/]{20,}={0,2})\b", "<hex>"),
    Rule("long_token", r"\b(?=[A-Za-z0-9_-]{12,}\b)(?=.*[A-Za-z])(?=.*\d)[A-Za-z0-9_-]+\b", "<id>", lookahead=True),
    Rule("mixed_token", r"\b[A-Za-z0-9]{18,}\b", "<id>"),
    Rule("number", r"\b\d+\b", "<id>"),
)

# "basic" profile (the first-generation normaliser): distinct tokens, no look-aheads.
BASIC_RULES: tuple[Rule, ...] = (
    Rule("uuid", r"\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<uuid>", ignore_case=True),
    Rule("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    Rule("ts", r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?\b", "<ts>", ignore_case=True),
    Rule("time", r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "<time>"),
    Rule("hex", r"\b0x[0-9a-f]+\b", "<hex>", ignore_case=True),
    Rule("num", r"\b\d+\b", "<num>"),
)

# --- end of fixed values

PROFILES = {"full": FULL_RULES, "basic": BASIC_RULES}
#: Profiles whose rules all match a digit, so that text without one stays as it is.
DIGIT_PROFILES = ("basic",)


def rules_for(profile: str, skip: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    try:
        rules = PROFILES[profile]
    except KeyError as exc:
        raise ValueError(f"unknown profile {profile!r}; use one of {sorted(PROFILES)}") from exc
    unknown = set(skip) - {r.name for r in rules}
    if unknown:
        raise ValueError(f"unknown rule(s) {sorted(unknown)} for profile {profile!r}")
    return tuple(r for r in rules if r.name not in skip)


#: Faster spellings for Java that match the same: a run that the next character can't be part of is not given
#: back, a look-ahead asks for what every branch begins with, and what must only exist is looked for forwards.
JAVA_FORMS = {
    "email": ("%+-]+@", "%+-]++@"),
    "ipv4": (r"\b(?:(?:25", r"\b(?=\d{1,3}\.)(?:(?:25"),
    "kv_id": (r"\b(trace", r"\b(?=[acejmorstu])(trace"),
    "long_token": (r"(?=.*[A-Za-z])(?=.*\d)", r"(?=.*?[A-Za-z])(?=.*?\d)"),
}


def _java_pattern(rule: Rule) -> str:
    # (?U): Unicode \b \d \s \w as in Python's str regexes; (?d): '.' stops
    # only at '\n' as in Python.
    flags = "U" + ("i" if rule.ignore_case else "") + ("d" if rule.lookahead else "")
    pattern = rule.pattern.replace(*JAVA_FORMS[rule.name], 1) if rule.name in JAVA_FORMS else rule.pattern
    return f"(?{flags}){pattern}"


def _re2_pattern(rule: Rule) -> str:
    if rule.lookahead:
        raise ValueError(f"rule {rule.name!r} needs look-ahead; RE2 cannot run it")
    return ("(?i)" if rule.ignore_case else "") + rule.pattern


def mask(col: Column, profile: str = "full", skip: tuple[str, ...] = ()) -> Column:
    """Apply the masking rules of ``profile`` in order."""
    out, rules = col, rules_for(profile, skip)
    for rule in rules:
        out = F.regexp_replace(out, _java_pattern(rule), rule.replacement)
    # One look for a digit instead of all rules, where every rule needs one.
    return F.when(F.regexp_like(col, F.lit(r"(?U)\d")), out).otherwise(col) if profile in DIGIT_PROFILES and rules else out


def collapse_ws(col: Column) -> Column:
    """Runs of whitespace to one blank, then trim."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def normalise(col: Column | str, profile: str = "full", lowercase: bool = True,
              normalize: bool = True, collapse_whitespace: bool = True,
              skip: tuple[str, ...] = ()) -> Column:
    """Full pre-processing chain: lowercase -> mask -> collapse."""
    c = F.col(col) if isinstance(col, str) else col
    if lowercase:
        c = F.lower(c)
    if normalize:
        c = mask(c, profile, skip)
    if collapse_whitespace:
        c = collapse_ws(c)
    return c


# ---------------------------------------------------------------- DuckDB SQL

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def normalise_sql(expr: str, profile: str = "full", lowercase: bool = True,
                  normalize: bool = True, collapse_whitespace: bool = True,
                  skip: tuple[str, ...] = ()) -> str:
    """The same chain as DuckDB SQL text (used by the oracle)."""
    out = f"lower({expr})" if lowercase else expr
    if normalize:
        for rule in rules_for(profile, skip):
            repl = rule.replacement.replace("$1", "\\1").replace("$2", "\\2")
            out = f"regexp_replace({out}, {_sql_str(_re2_pattern(rule))}, {_sql_str(repl)}, 'g')"
    if collapse_whitespace:
        out = f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"
    return out
