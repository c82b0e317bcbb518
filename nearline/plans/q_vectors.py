"""Vector search queries over ``embeddings``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import vectors as V
from ..sources.tables import table
from .registry import register

DIM = 64
K = 10
# Query vectors are parameters built by a rule (unit vectors of sines).
QUERY = V.unit([math.sin(i + 1.0) for i in range(DIM)])


def _arr(v) -> str:
    return "[" + ", ".join(repr(float(x)) for x in v) + "]::DOUBLE[]"


def dot_sql(a: str, b: str) -> str:
    """Left-to-right sum, the same order as Spark's ``aggregate``."""
    return (f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: ({a})[i] * ({b})[i]), "
            f"lambda x, y: x + y, 0.0)")


def norm_sql(a: str) -> str:
    return f"sqrt(list_reduce(list_transform({a}, lambda x: x * x), lambda x, y: x + y, 0.0))"


def score_sql(metric: str, a: str, b: str) -> str:
    if metric == "dot":
        return dot_sql(a, b)
    if metric == "cosine":
        return (f"CASE WHEN {norm_sql(a)} * {norm_sql(b)} = 0 THEN 0.0 "
                f"ELSE {dot_sql(a, b)} / ({norm_sql(a)} * {norm_sql(b)}) END")
    return (f"sqrt(list_reduce(list_transform(range(1, len({a}) + 1), lambda i: (({a})[i] - ({b})[i]) * (({a})[i] - ({b})[i])), "
            f"lambda x, y: x + y, 0.0))")


def _order(metric: str) -> str:
    return "score ASC" if metric == "euclidean" else "score DESC"


def _topk_sql(metric: str) -> str:
    s = score_sql(metric, "embedding::DOUBLE[]", _arr(QUERY))
    return (f"SELECT vec_id, label, round(score, 6) AS score, "
            f"row_number() OVER (ORDER BY {_order(metric)}, vec_id) AS rank FROM "
            f"(SELECT vec_id, label, {s} AS score FROM embeddings) ORDER BY {_order(metric)}, vec_id LIMIT {K}")


def _make_topk(metric: str):
    def q(spark, sf):
        emb = table(spark, sf, "embeddings")
        out = V.topk(emb, "vec_id", "embedding", QUERY, K, metric, keep=["label"])
        return out.select("vec_id", "label", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))
    q.__name__ = f"q_topk_{metric}"
    return q


for _m, _ops in (("cosine", "D1 D4"), ("euclidean", "D2 D4"), ("dot", "D3 D4")):
    register(f"topk_{_m}", _ops, (lambda m: lambda: _topk_sql(m))(_m))(_make_topk(_m))


@register("topk_vector_only", "D6", lambda: (
    f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, {score_sql('dot', 'embedding::DOUBLE[]', _arr(QUERY))} AS score "
    f"FROM embeddings) ORDER BY score DESC, vec_id LIMIT 3"))
def q_topk_vector_only(spark, sf):
    out = V.topk(table(spark, sf, "embeddings"), "vec_id", "embedding", QUERY, 3, "dot")
    return out.select("vec_id", F.round("score", 6).alias("score"))


@register("topk_filtered", "D7 E1", lambda: (
    f"SELECT vec_id, label, round(score, 6) AS score FROM (SELECT vec_id, label, "
    f"{score_sql('cosine', 'embedding::DOUBLE[]', _arr(QUERY))} AS score FROM embeddings WHERE label = 1) "
    f"ORDER BY score DESC, vec_id LIMIT {K}"))
def q_topk_filtered(spark, sf):
    emb = table(spark, sf, "embeddings")
    out = V.topk(emb, "vec_id", "embedding", QUERY, K, "cosine", where=F.col("label") == 1, keep=["label"])
    return out.select("vec_id", "label", F.round("score", 6).alias("score"))


def _batch_sql(cond: str) -> str:
    """Every row whose id is divisible by 20 against all rows."""
    return (f"SELECT qid, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY qid ORDER BY round(score, {V.DIGITS}) DESC, vec_id) AS rank FROM (SELECT q.vec_id AS qid, p.vec_id, "
            f"{score_sql('cosine', 'q.embedding::DOUBLE[]', 'p.embedding::DOUBLE[]')} AS score "
            f"FROM embeddings q JOIN embeddings p ON q.vec_id % 20 = 0 AND {cond})) WHERE rank <= {K}")


def _asked(spark, sf):
    points = table(spark, sf, "embeddings")
    return points, points.where(F.col("vec_id") % 20 == 0)


def _ranked(out):
    return out.select("qid", F.col("rank").cast("bigint"), F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@register("batch_search", "D5 H1", lambda: _batch_sql("true"),
          note="queries: every row whose id is divisible by 20, against all rows, in blocks")
def q_batch_search(spark, sf):
    points, asked = _asked(spark, sf)
    return _ranked(V.search_blocks(points, "vec_id", "embedding", asked, "vec_id", "embedding", K))


@register("batch_search_filtered", "D5 D7 H1", lambda: _batch_sql("p.label = q.label"),
          note="the same queries, each with a filter of its own: the points of its own label")
def q_batch_search_filtered(spark, sf):
    points, asked = _asked(spark, sf)
    return _ranked(V.search_blocks(points, "vec_id", "embedding", asked, "vec_id", "embedding", K, same=("label", "label")))


def _self_nearest_sql() -> str:
    """From the definition: the nearest of all other rows."""
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
scored AS (SELECT x.vec_id AS a, y.vec_id AS b, round({score_sql('cosine', 'x.e', 'y.e')}, {V.DIGITS}) AS score FROM e x JOIN e y ON x.vec_id <> y.vec_id)
SELECT a AS vec_id, b AS neighbour, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM scored) WHERE rn = 1"""


@register("self_nearest", "F4 H2 D8", _self_nearest_sql,
          note="an index calibrated for recall; on these vectors (no structure) its exact route")
def q_self_nearest(spark, sf):
    out = V.nearest_others(table(spark, sf, "embeddings"), "vec_id", "embedding", "cosine")
    return out.select("vec_id", "neighbour", F.round("score", 6).alias("score"))
