"""Functional-graph star decomposition by contraction.

Input: ``edges(src, dst, sim)`` with out-degree <= 1, optional ``nodes(id)``.
Output: one row per node ``(node, anchor, sim, is_anchor)``; every node is in
exactly one star.

A graph of at most ``CHUNK`` nodes is resolved in one task, by pointer doubling
on arrays.  A larger one is contracted first: a hash of the round and the node
tosses a coin for every node, and nodes with heads that point at a node with
tails are spliced out, their predecessors pointing on with the weights folded.
No two neighbours go in one round, so one salted join does it; about a quarter
of the nodes goes, whatever the lengths of paths and cycles, and rounds work on
ever smaller tables.  For anchors, a pointer carries the best node that was
spliced out below it, and a cycle ends as a node that points at itself.  For
stars, nodes that went come back in the opposite order, a join each.  Every
round is written, so a lost executor replays one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .skew import salted_join

COMBINES = ("min", "product")
ANCHORS = ("max_in_sum", "min_id")


CHUNK = 500_000                      # nodes that one task resolves


def check_out_degree(edges: DataFrame, src: str = "src") -> None:
    """A node with two out-edges is an error (two equal edges count too)."""
    bad = edges.groupBy(src).count().where(F.col("count") > 1).limit(1).collect()
    if bad:
        raise ValueError(f"node {bad[0][src]!r} has {bad[0]['count']} out-edges, one is allowed")


def _comb(a: Column, b: Column, combine: str) -> Column:
    return F.least(a, b) if combine == "min" else a * b


def _spliced(state: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """``(nodes that stay, nodes that go)`` of one round."""
    coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), F.col(c).cast("string")), F.lit(2))
    goes = (F.col("node") != F.col("nxt")) & (coin("node") == 1) & (coin("nxt") == 0)
    return state.where(~goes), state.where(goes)


def _places(node: pa.ChunkedArray, nxt: pa.ChunkedArray) -> np.ndarray:
    """Of every node, the place of the node it points at; -1: not in the table."""
    names = pa.concat_arrays([*node.chunks, *nxt.chunks]).dictionary_encode()
    code = names.indices.to_numpy()
    at = np.full(len(names.dictionary), -1)
    at[code[:len(node)]] = np.arange(len(node))
    return at[code[len(node):]]


def _in_one_task(state: DataFrame, solve, schema) -> DataFrame:
    """``solve`` on a table of at most ``CHUNK`` rows."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from solve(pa.Table.from_batches(held)).to_batches()

    return state.repartition(1).mapInArrow(run, schema)


def resolve(state: DataFrame, combine: str, chunk: int | None = None) -> DataFrame:
    """``(node, root, acc)`` of a forest ``(node, nxt, acc)`` whose roots point at
    themselves: the root of every node, and the weights on the way folded."""
    chunk = CHUNK if chunk is None else chunk
    schema = T.StructType([T.StructField("node", state.schema["node"].dataType), T.StructField("root", state.schema["node"].dataType),
                           T.StructField("acc", T.DoubleType())])
    product = combine == "product"

    def solve(t: pa.Table) -> pa.Table:
        to, weight = _places(t.column("node"), t.column("nxt")), t.column("acc").to_numpy()
        last = to < 0                                             # these point at a root
        to = np.where(last, np.arange(len(to)), to)
        acc = np.where(last, 1.0 if product else np.inf, weight)
        while True:
            further = to[to]
            acc = acc * np.where(to == np.arange(len(to)), 1.0, acc[to]) if product else np.minimum(acc, acc[to])
            if (further == to).all():
                break
            to = further
        acc = acc * weight[to] if product else np.minimum(acc, weight[to])
        return pa.table({"node": t.column("node"), "root": t.column("nxt").take(pa.array(to)), "acc": pa.array(acc)})

    state, gone, turn = cut_lineage(state, "forest"), [], 0
    roots = state.where("node = nxt").select("node", F.col("nxt").alias("root"), "acc")
    state = state.where("node <> nxt")
    while (n := state.count()) > chunk:
        stay, go = _spliced(state, turn)
        next_ = go.select(F.col("node").alias("nxt"), F.col("nxt").alias("__nxt"), F.col("acc").alias("__acc"))
        joined = salted_join(stay, next_, ["nxt"], "left", salt_by=["node"], total=n)
        state = cut_lineage(joined.select("node", F.coalesce("__nxt", "nxt").alias("nxt"),
                                          F.when(F.col("__nxt").isNull(), F.col("acc")).otherwise(_comb(F.col("acc"), F.col("__acc"), combine)).alias("acc")), "forest")
        gone.append(go)
        turn += 1
    done = roots.unionByName(_in_one_task(state, solve, schema))
    for go in reversed(gone):
        done = cut_lineage(done, "resolved")
        back = done.select(F.col("node").alias("nxt"), "root", F.col("acc").alias("__acc"))
        done = done.unionByName(salted_join(go, back, ["nxt"], "inner", salt_by=["node"]).select("node", "root", _comb(F.col("acc"), F.col("__acc"), combine).alias("acc")))
    return done


def cycle_anchors(succ: DataFrame, chunk: int | None = None) -> DataFrame:
    """``(node)``: one anchor for every cycle of ``(node, nxt, rank)``: the node of
    the smallest (rank, id) on it.  A node that points at itself is a cycle."""
    chunk = CHUNK if chunk is None else chunk
    node_type = succ.schema["node"].dataType

    def solve(t: pa.Table) -> pa.Table:
        to = _places(t.column("node"), t.column("nxt"))
        out = to < 0                                              # these lead to a cycle that is closed already
        to = np.where(out, np.arange(len(to)), to)
        rank = t.column("rank").to_numpy()
        names = t.column("best").combine_chunks().dictionary_encode()
        by_name = np.empty(len(names.dictionary), np.int64)
        by_name[pa.compute.array_sort_indices(names.dictionary).to_numpy()] = np.arange(len(by_name))
        order = np.lexsort((by_name[names.indices.to_numpy()], rank))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))                      # how good a node's candidate is
        far = to
        for _ in range(len(to).bit_length()):                     # as many steps as there are nodes at least
            far = far[far]
        on = np.unique(far)                                       # all nodes on cycles, and no others
        on = on[~out[on]]
        inside = np.empty(len(to), np.int64)
        inside[on] = np.arange(len(on))
        step, best = inside[to[on]], place[on]
        for _ in range(len(on).bit_length()):                     # the best within ever longer windows
            best, step = np.minimum(best, best[step]), step[step]
        return pa.table({"node": t.column("best").take(pa.array(order[np.unique(best)]))})

    state, turn, closed = cut_lineage(succ.select("node", "nxt", "rank", F.col("node").alias("best")), "cycles"), 0, []
    while True:
        closed.append(state.where("node = nxt").select(F.col("best").alias("node")))
        state = state.where("node <> nxt")
        if (n := state.count()) <= chunk:
            break
        stay, go = _spliced(state, turn)
        next_ = go.select(F.col("node").alias("nxt"), F.col("nxt").alias("__nxt"), F.col("rank").alias("__rank"), F.col("best").alias("__best"))
        joined = salted_join(stay, next_, ["nxt"], "left", salt_by=["node"], total=n)
        best = F.least(F.struct("rank", "best"), F.when(F.col("__nxt").isNotNull(), F.struct(F.col("__rank").alias("rank"), F.col("__best").alias("best"))))
        state = cut_lineage(joined.select("node", F.coalesce("__nxt", "nxt").alias("nxt"), best.alias("b")).select("node", "nxt", "b.rank", "b.best"), "cycles")
        turn += 1
    out = _in_one_task(state, solve, T.StructType([T.StructField("node", node_type)]))
    for more in closed:
        out = out.unionByName(more)
    return out


def all_nodes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """H7: union of edge ends and the given node list, distinct."""
    parts = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    if nodes is not None:
        parts = parts.union(nodes.select(F.col(nodes.columns[0]).alias("node")))
    return parts.distinct()


def star_decompose(edges: DataFrame, nodes: DataFrame | None = None, combine: str = "min",
                   cycle_anchor: str = "max_in_sum", check: bool = True) -> DataFrame:
    """Depth-1 clusters of a functional graph.

    Returns ``(node, anchor, sim, is_anchor)``.  Anchors carry sim 1.0;
    ``combine`` folds the weights along the path to the anchor (``min``:
    bottleneck, capped at 1.0; ``product``: decay).
    """
    if combine not in COMBINES:
        raise ValueError(f"combine is one of {COMBINES}, not {combine!r}")
    if cycle_anchor not in ANCHORS:
        raise ValueError(f"cycle_anchor is one of {ANCHORS}, not {cycle_anchor!r}")
    e = edges.select(F.col("src"), F.col("dst"), F.col("sim").cast("double").alias("sim"))
    if check:
        check_out_degree(e)
    v = all_nodes(e, nodes)
    succ = (v.join(e.withColumnRenamed("src", "node"), "node", "left")
            .select("node", F.coalesce("dst", "node").alias("nxt"), F.coalesce("sim", F.lit(1.0)).alias("w")))
    if cycle_anchor == "max_in_sum":
        insum = e.groupBy(F.col("dst").alias("node")).agg(F.sum("sim").alias("in_sum"))  # G3
        rank = -F.round(F.coalesce("in_sum", F.lit(0.0)), 9)
        succ = succ.join(insum, "node", "left").select("node", "nxt", "w", rank.alias("rank"))
    else:
        succ = succ.select("node", "nxt", "w", F.lit(0.0).alias("rank"))
    succ = cut_lineage(succ, "succ")

    # One anchor per cycle; a sink is a cycle of its own.
    anchors = cycle_anchors(succ.select("node", "nxt", "rank")).withColumn("__a", F.lit(True))

    # Cut each anchor's out-edge, then resolve the forest with the weight fold.
    cut = (succ.join(anchors, "node", "left")
           .select("node",
                   F.when(F.col("__a"), F.col("node")).otherwise(F.col("nxt")).alias("nxt"),
                   F.when(F.col("__a"), F.lit(1.0)).otherwise(F.col("w")).alias("acc")))
    done = resolve(cut, combine)
    sim = F.least(F.col("acc"), F.lit(1.0)) if combine == "min" else F.col("acc")
    return done.select("node", F.col("root").alias("anchor"), sim.alias("sim"),
                       (F.col("node") == F.col("root")).alias("is_anchor"))


def resolve_forest(links: DataFrame, nodes: DataFrame, combine: str = "min") -> DataFrame:
    """Roots of an acyclic out-degree-1 graph (every link points to a smaller id).

    ``links(node, nxt, w)``; nodes without a link are roots.  Returns
    ``(node, root, sim)``.
    """
    state = (nodes.select(F.col(nodes.columns[0]).alias("node"))
             .join(links, "node", "left")
             .select("node", F.coalesce("nxt", "node").alias("nxt"),
                     F.coalesce("w", F.lit(1.0)).alias("acc")))
    done = resolve(state, combine)
    sim = F.least(F.col("acc"), F.lit(1.0)) if combine == "min" else F.col("acc")
    return done.select("node", "root", sim.alias("sim"))


def star_sink(stars: DataFrame) -> DataFrame:
    """Flat star rows in output order (anchor, sim desc, member asc).

    An anchor without members keeps one row, its member and sim null.  Range
    partitioning on the full sort key splits a hot anchor's members over many
    tasks; nothing is collected into one list.
    """
    members = stars.where(~F.col("is_anchor")).select("anchor", F.col("node").alias("member"), "sim")
    lone = stars.groupBy("anchor").agg(F.count_if(~F.col("is_anchor")).alias("__n"), F.first("node").alias("__node")).where("__n = 0")
    none = F.when(F.lit(False), F.col("__node"))
    rows = members.unionByName(lone.select("anchor", none.alias("member"), F.lit(None).cast("double").alias("sim")))
    return rows.orderBy("anchor", F.desc("sim"), "member")


def write_stars(stars: DataFrame, path: str) -> None:
    """The sink's rows as Parquet, a folder that is replaced as a whole."""
    star_sink(stars).write.mode("overwrite").parquet(path)
