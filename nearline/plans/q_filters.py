"""Filter-language queries (E1-E17) over the event points."""

from __future__ import annotations

from ..operators import filters as FL
from ..sources.points import EVENT_POINTS_SQL, event_points
from .registry import register

P = f"({EVENT_POINTS_SQL})"

# Ids for the has_id filter: a rule over the id range, not a sample.
HAS_ID = [i * i for i in range(1, 200)]

CASES = {
    "filter_eq": ("E1", {"key": "severity", "op": "equals", "value": "ERROR"},
                  "severity = 'ERROR'"),
    "filter_payload_eq": ("E1", {"key": "k", "dtype": "integer", "op": "eq", "value": 42},
                          "json_extract(payload_json, '$.k')::BIGINT = 42"),
    "filter_in": ("E2", {"key": "severity", "op": "in", "value": ["ERROR", "PURCHASE"]},
                  "severity IN ('ERROR', 'PURCHASE')"),
    "filter_not_in": ("E3", {"key": "note", "op": "not_in", "value": ["v=1.5", "v=2.25"]},
                      "json_extract_string(payload_json, '$.note') IS NOT NULL "
                      "AND json_extract_string(payload_json, '$.note') NOT IN ('v=1.5', 'v=2.25')"),
    "filter_array_eq": ("E1", {"key": "tags", "op": "equals", "value": "error"},
                        "list_contains(from_json(payload_json -> '$.tags', '[\"VARCHAR\"]'), 'error')"),
    "filter_array_in": ("E2", {"key": "tags", "op": "in", "value": ["user7", "click", 3]},
                        "list_has_any(from_json(payload_json -> '$.tags', '[\"VARCHAR\"]'), ['user7', 'click'])"),
    "filter_array_not_in": ("E3", {"key": "tags", "op": "not_in", "value": ["user7", "click", "purchase", "error"]},
                            "len(list_filter(from_json(payload_json -> '$.tags', '[\"VARCHAR\"]'), "
                            "lambda x: x NOT IN ('user7', 'click', 'purchase', 'error'))) > 0"),
    "filter_mixed_in": ("E2", {"key": "k", "op": "in", "value": ["x", 1, 42]},
                        "json_extract(payload_json, '$.k')::BIGINT IN (1, 42)"),
    "filter_contains": ("E4", {"key": "text_payload", "op": "contains", "value": "took 1"},
                        "contains(text_payload, 'took 1')"),
    "filter_phrase": ("E5", {"key": "text_payload", "op": "phrase", "value": "code 3 trace"},
                      "instr(' ' || regexp_replace(text_payload, '\\W+', ' ', 'g') || ' ', ' code 3 trace ') > 0"),
    "filter_prefix": ("E6", {"key": "text_payload", "op": "prefix", "value": "ERROR 2024-01-0"},
                      "starts_with(text_payload, 'ERROR 2024-01-0')"),
    "filter_exists": ("E7", {"key": "note", "op": "exists"},
                      "json_type(payload_json, '$.note') IS NOT NULL AND json_type(payload_json, '$.note') <> 'NULL'"),
    "filter_is_null": ("E8", {"key": "note", "op": "is_null"},
                       "coalesce(json_type(payload_json, '$.note') = 'NULL', false)"),
    "filter_is_empty": ("E9", {"key": "tags", "op": "is_empty"},
                        "json_type(payload_json, '$.tags') IS NULL OR json_type(payload_json, '$.tags') = 'NULL' "
                        "OR json_array_length(payload_json, '$.tags') = 0"),
    "filter_range": ("E10", [{"key": "value", "dtype": "float", "op": "gte", "value": 10},
                             {"key": "value", "dtype": "float", "op": "lt", "value": 50},
                             {"key": "k", "dtype": "integer", "op": "gt", "value": 50}],
                     "value >= 10 AND value < 50 AND json_extract(payload_json, '$.k')::DOUBLE > 50"),
    "filter_datetime": ("E11 E12", {"key": "ts", "dtype": "datetime", "op": "between",
                                    "value": "2024-01-10T00:00:00Z, 2024-01-12T12:00:00Z"},
                        "ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 12:00:00'"),
    "filter_between_list": ("E12", {"key": "value", "op": "range", "value": [20, 30]},
                            "value >= 20 AND value <= 30"),
    "filter_has_id": ("E13", {"op": "has_id", "value": HAS_ID},
                      "id IN (" + ", ".join(str(i) for i in HAS_ID) + ")"),
    "filter_and": ("E14", {"logic": "and", "clauses": [
        {"key": "severity", "op": "equals", "value": "CLICK"},
        {"logic": "or", "clauses": [{"key": "pod_name", "op": "equals", "value": "pod-1"},
                                    {"key": "value", "op": "gt", "value": 90}]}]},
                   "severity = 'CLICK' AND (pod_name = 'pod-1' OR value > 90)"),
    "filter_or": ("E15", {"logic": "OR", "clauses": [
        {"key": "severity", "op": "equals", "value": "SIGNUP"},
        {"key": "note", "op": "is_null"}]},
                  "severity = 'SIGNUP' OR coalesce(json_type(payload_json, '$.note') = 'NULL', false)"),
    "filter_not": ("E16", {"logic": "not", "clauses": [
        {"key": "severity", "op": "equals", "value": "ERROR"},
        {"key": "note", "op": "exists"}]},
                   "NOT (severity = 'ERROR' OR (json_type(payload_json, '$.note') IS NOT NULL "
                   "AND json_type(payload_json, '$.note') <> 'NULL'))"),
    "filter_spec_list": ("E17", [
        {"logic": "or", "clauses": [{"key": "severity", "op": "in", "value": ["VIEW", "CLICK"]}]},
        {"logic": "not", "clauses": [{"key": "pod_name", "op": "equals", "value": "pod-0"}]}],
                         "severity IN ('VIEW', 'CLICK') AND NOT (pod_name = 'pod-0')"),
}


def _make(name: str, spec):
    def q(spark, sf):
        pts = event_points(spark, sf)
        return FL.apply(pts, spec).select("id", "severity")
    q.__name__ = f"q_{name}"
    return q


for _name, (_ops, _spec, _cond) in CASES.items():
    register(_name, _ops + " E18", f"SELECT id, severity FROM {P} WHERE {_cond}")(_make(_name, _spec))
