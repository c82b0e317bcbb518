"""Query catalogue: each entry is a Spark job over the driver's tables plus,
where SQL can express it, the DuckDB statement that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class QuerySpec:
    name: str
    fn: QueryFn
    ops: tuple[str, ...]
    sql: str | Callable[[], str] | None = None
    note: str = ""
    tags: tuple[str, ...] = field(default=())

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return self.sql() if callable(self.sql) else self.sql


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, ops: str, sql: str | Callable[[], str] | None = None, note: str = ""):
    """Decorator: add a ``(spark, sf_dir) -> DataFrame`` query to the catalogue."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name!r}")
        REGISTRY[name] = QuerySpec(name, fn, tuple(ops.split()), sql, note)
        return fn
    return deco
