"""Dense-vector scoring, top-k search and LSH neighbours.

Scores are built-in higher-order expressions (``zip_with`` + ``aggregate``)
over ``ARRAY<DOUBLE>``, evaluated next to the scan.  Top-k over a table is
``orderBy(...).limit(k)`` (TakeOrderedAndProject: each task keeps k rows).
Batched search compares blocks of queries with blocks of points inside tasks
and keeps k rows per query and block; one window merges them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .tiles import DIGITS, best_of_lists, best_partners, matrix

METRICS = ("cosine", "euclidean", "dot")


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """D3."""
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Dot / (|a| |b|); a zero norm gives 0."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def euclidean(a: Column, b: Column) -> Column:
    """D2 (lower is better)."""
    return F.sqrt(F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                              lambda s, v: s + v))


def score(metric: str, a: Column, b: Column) -> Column:
    if metric == "cosine":
        return cosine(a, b)
    if metric == "euclidean":
        return euclidean(a, b)
    if metric == "dot":
        return dot(a, b)
    raise ValueError(f"metric is one of {METRICS}, not {metric!r}")


def better_first(metric: str, col: str = "score") -> Column:
    return F.col(col).asc() if metric == "euclidean" else F.col(col).desc()


def _lit_vec(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def topk(points: DataFrame, id_col: str, vec_col: str, query, k: int = 5, metric: str = "cosine",
         where: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The k best points for one query vector.

    The filter runs before scoring and limit (never a post-filtered top-k).
    ``keep`` lists payload columns to return (D6 returns none).
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}, not {metric!r}")
    src = points if where is None else points.where(where)
    cols = [F.col(id_col)] + [F.col(c) for c in (keep or [])]
    scored = src.select(*cols, score(metric, F.col(vec_col), _lit_vec(query)).alias("score"))
    ranked = scored.orderBy(better_first(metric), F.col(id_col).asc()).limit(k)
    # ranks the k rows left after the limit (already one partition), not the table
    w = Window.orderBy(better_first(metric), F.col(id_col).asc())
    return ranked.withColumn("rank", F.row_number().over(w))


def search_blocks(points: DataFrame, id_col: str, vec_col: str, queries: DataFrame, qid_col: str, qvec_col: str, k: int = 5,
                  metric: str = "cosine", filters: list[Column] | None = None, filter_col: str | None = None,
                  same: tuple[str, str] | None = None, not_self: bool = False, point_rows: int = 16384, query_rows: int = 2048) -> DataFrame:
    """The ``k`` best points of every query of a table, ``(qid, rank, id, score)``.

    Both tables are dealt into blocks by a hash of their ids, and every block of
    queries meets every block of points in a task of its own, as a matrix of
    costs; a task keeps ``k`` rows per query, and the blocks' rows are ranked
    per query with a partial limit before the shuffle.  Memory is bounded by
    the block sizes, whatever the tables' sizes; nothing passes the driver but
    two counts.  Ties go to the smaller id.

    A query's own filter: ``filter_col`` (of ``queries``) has the place of a
    condition in ``filters``, null for none; ``same`` names a column of the
    points and one of the queries that must be equal (null is equal to
    nothing).  ``not_self`` leaves out the point whose id is the query's.
    Rows without a vector take no part.
    """
    if k < 1:
        raise ValueError("k from 1")
    if (filters is None) != (filter_col is None):
        raise ValueError("filters and filter_col go together")
    costs, filtered, equal = cost_blocks(metric), bool(filters), same is not None      # what tasks need of the arguments
    none = F.lit(None).cast("string")
    p = points.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.array(*[F.coalesce(f, F.lit(False)) for f in filters or []]).cast("array<boolean>").alias("ok"),
        (F.col(same[0]).cast("string") if same else none).alias("same"))
    q = queries.where(F.col(qvec_col).isNotNull()).select(
        F.col(qid_col).alias("qid"), F.col(qvec_col).alias("v"), (F.col(filter_col) if filter_col else F.lit(None)).cast("int").alias("f"),
        (F.col(same[1]).cast("string") if same else none).alias("same"))
    nq, np_ = max(1, -(-q.count() // query_rows)), max(1, -(-p.count() // point_rows))
    np_ = max(np_, min(points.sparkSession.sparkContext.defaultParallelism // nq, 64))       # no result depends on it
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = p.select("*", block("id", np_).alias("pb")).select("*", every(nq).alias("qb"))
    q = q.select("*", block("qid", nq).alias("qb")).select("*", every(np_).alias("pb"))
    id_type, qid_type = p.schema["id"].dataType, q.schema["qid"].dataType
    schema = T.StructType([T.StructField("qid", qid_type), T.StructField("id", id_type), T.StructField("cost", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qid", "id", "cost"]
        if not left.num_rows or not right.num_rows:
            return pa.table([right.column("qid").slice(0, 0), left.column("id").slice(0, 0), pa.array([], pa.float64())], names=names)
        left = left.sort_by("id").combine_chunks()               # the first least: the smaller id
        ids, block_ = left.column("id"), matrix(left, "v")
        ok = np.array(left.column("ok").to_pylist(), bool) if filtered else None
        f = right.column("f").to_pylist()
        mine, theirs = (np.array(t.column("same").to_pylist(), object) for t in (left, right)) if equal else (None, None)
        own = {x: i for i, x in enumerate(ids.to_pylist())} if not_self else {}
        at, of, cost = [], [], []
        asked, qids = matrix(right, "v"), right.column("qid").to_pylist()
        for a in range(0, len(asked), 64):
            m = np.round(costs(asked[a:a + 64], block_), DIGITS)
            for j, row in enumerate(m):
                i = a + j
                if filtered and f[i] is not None:
                    row = np.where(ok[:, f[i]], row, np.inf)
                if equal:
                    row = np.where((mine == theirs[i]) & (theirs[i] is not None), row, np.inf)
                if qids[i] in own:
                    row[own[qids[i]]] = np.inf
                cut = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
                some = np.flatnonzero((row <= cut) & np.isfinite(row))
                some = some[np.argsort(row[some], kind="stable")][:k]
                at.append(some)
                of.append(np.full(len(some), i))
                cost.append(row[some])
        return pa.table([right.column("qid").take(pa.array(np.concatenate(of))), ids.take(pa.array(np.concatenate(at))),
                         pa.array(np.concatenate(cost).astype(np.float64))], names=names)

    found = p.groupBy("qb", "pb").cogroup(q.groupBy("qb", "pb")).applyInArrow(run, schema)
    w = Window.partitionBy("qid").orderBy("cost", "id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("qid", "rank", "id", (F.col("cost") if metric == "euclidean" else -F.col("cost")).alias("score")))


def cost_blocks(metric: str):
    """The matrix of costs (less is better) between two blocks of vectors; ``jaccard``
    is the share of equal places (of signatures)."""
    if metric not in (*METRICS, "jaccard"):
        raise ValueError(f"metric is one of {(*METRICS, 'jaccard')}, not {metric!r}")

    def costs(a, b):
        if metric == "jaccard":
            return -np.stack([(b == x[None, :]).sum(axis=1) / b.shape[1] for x in a])
        a, b = a.astype(np.float64), b.astype(np.float64)
        if metric == "euclidean":
            return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))
        product = a @ b.T
        if metric == "dot":
            return -product
        norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        return -np.where(norms == 0, 0.0, product / np.where(norms == 0, 1.0, norms))
    return costs


# ------------------------------------------------------------ nearest other point of every point

@dataclass(frozen=True)
class IndexParams:
    """Lists of a coarse quantiser.  Bounds, whatever the table's size: centroids
    are fitted on ``sample`` rows, calibrated with ``asks`` rows, and at most
    ``most_lists`` are broadcast in tasks."""
    sample: int = 20_000
    asks: int = 400
    most_lists: int = 1024
    recall: float = 0.97                 # of the asks' true nearest points, in the lists probed
    rounds: int = 6


def _some(points: DataFrame, n: int, salt: int) -> DataFrame:
    """``n`` rows by the smallest hashes of their ids: the same at every run."""
    return points.orderBy(F.xxhash64(F.lit(salt), "id"), "id").limit(n)


def fit_lists(points: DataFrame, metric: str, params: IndexParams) -> np.ndarray:
    """Centroids of ``(id, v)`` rows by k-means on a bounded sample."""
    rows = _some(points, params.sample, 1).select("v").toArrow()
    x = matrix(rows, "v").astype(np.float64)
    if metric == "cosine":
        x = _unit_rows(x)
    lists = int(min(params.most_lists, max(1, round(math.sqrt(len(x))))))
    c = x[:lists].copy()                                         # rows in hash order: a random choice
    for _ in range(params.rounds):
        own = np.concatenate([_list_costs(metric, x[a:a + 4096], c).argmin(axis=1) for a in range(0, len(x), 4096)])
        size = np.bincount(own, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        if metric == "cosine":
            c = _unit_rows(c)
    return c


def _unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def _list_costs(metric: str, x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.round(cost_blocks(metric)(x, centroids), DIGITS)


def probes_needed(points: DataFrame, centroids: np.ndarray, metric: str, params: IndexParams) -> int:
    """How many lists a point must look into, nearest centroids first, so that a
    share of ``recall`` of the sampled points finds its true nearest one, which
    an exact search over all rows tells."""
    asks = cut_lineage(_some(points, params.asks, 2), "index_asks")
    best = search_blocks(points, "id", "v", asks, "id", "v", 1, metric, not_self=True).select("qid", F.col("id").alias("near"))
    both = (asks.withColumnRenamed("id", "qid").join(best, "qid")
            .join(points.select(F.col("id").alias("near"), F.col("v").alias("w")), "near")).select("v", "w").toArrow()
    if not both.num_rows:
        return len(centroids)
    order = np.argsort(_list_costs(metric, matrix(both, "v"), centroids), axis=1, kind="stable")
    own = _list_costs(metric, matrix(both, "w"), centroids).argmin(axis=1)
    rank = np.sort((order == own[:, None]).argmax(axis=1) + 1)
    return int(rank[min(len(rank) - 1, math.ceil(params.recall * len(rank)) - 1)])


def nearest_others(points: DataFrame, id_col: str, vec_col: str, metric: str = "cosine", params: IndexParams = IndexParams(),
                   chunk: int = 4000) -> DataFrame:
    """``(id, neighbour, score)``: each point's nearest *other* point, ties
    to the smaller id; a point alone in the table has no row.

    Every row is stored in the list of its nearest centroid and looks into as
    many lists as the calibration found necessary for the wanted recall, in
    tiles.  Where that is half of all lists or more (points without structure,
    small tables), comparing every two blocks of the table costs no more, and
    the result is exact.  Points that meet no other in their lists are searched
    exactly.  Vectors that are null take no part; ids are longs.
    """
    rows = points.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), _d(F.col(vec_col)).alias("v"))
    rows = cut_lineage(rows, "index_rows")
    score_col = F.col("cost") if metric == "euclidean" else -F.col("cost")
    said = lambda best: best.select(F.col("id").alias(id_col), F.col("partner").alias("neighbour"), score_col.alias("score"))
    costs = cost_blocks(metric)
    if rows.isEmpty():
        return said(rows.select("id", F.col("id").alias("partner"), F.lit(0.0).alias("cost")))
    centroids = fit_lists(rows, metric, params)
    probes = probes_needed(rows, centroids, metric, params)
    if 2 * probes >= len(centroids):
        return said(best_partners(rows.withColumn("g", F.lit(1)), "g", "id", "v", costs, chunk))

    def listed(how_many):
        def run(batches):
            for b in batches:
                order = np.argsort(_list_costs(metric, matrix(pa.Table.from_batches([b]), "v"), centroids), axis=1, kind="stable")[:, :how_many]
                for a in range(how_many):
                    yield pa.RecordBatch.from_arrays([pa.array(order[:, a].astype(np.int32)), b.column("id"), b.column("v")], names=["g", "id", "v"])
        return rows.mapInArrow(run, "g int, id long, v array<double>")

    found = cut_lineage(best_of_lists(listed(probes), listed(1), costs, chunk), "index_best")
    alone = cut_lineage(rows.join(found.select("id"), "id", "left_anti"), "index_alone")
    rest = search_blocks(rows, "id", "v", alone, "id", "v", 1, metric, not_self=True).select(
        F.col("qid").alias("id"), F.col("id").alias("partner"), (F.col("score") if metric == "euclidean" else -F.col("score")).alias("cost"))
    return said(found.unionByName(rest))


def unit(v) -> list[float]:
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]
