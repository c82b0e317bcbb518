"""Functional-graph star clustering queries.

The graph is derived from ``customer``: every customer with a non-negative
balance points at ``1 + (key^2 + 7) mod max_key`` (a quadratic map: trees
feeding into cycles); customers in debt are sinks.  Weight
``(key mod 64 + 1) / 64`` keeps sums exact, so anchor ties are decided by id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.tables import table
from .registry import register


def customer_graph(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    n = c.select(F.max("c_custkey")).scalar()
    edges = (c.where(F.col("c_acctbal") >= 0)
             .select(F.col("c_custkey").alias("src"),
                     (F.lit(1) + F.pmod(F.col("c_custkey") * F.col("c_custkey") + 7, n)).alias("dst"),
                     ((F.pmod("c_custkey", F.lit(64)) + 1) / 64.0).alias("sim")))
    nodes = c.select(F.col("c_custkey").alias("id"))
    return edges, nodes


GRAPH_SQL = """
e AS (SELECT c_custkey AS src, 1 + (c_custkey * c_custkey + 7) % (SELECT max(c_custkey) FROM customer) AS dst,
             ((c_custkey % 64) + 1) / 64.0 AS sim FROM customer WHERE c_acctbal >= 0),
v AS (SELECT c_custkey AS node FROM customer UNION SELECT src FROM e UNION SELECT dst FROM e),
succ AS (SELECT v.node, coalesce(e.dst, v.node) AS nxt, coalesce(e.sim, 1.0) AS w, e.dst IS NULL AS is_sink
         FROM v LEFT JOIN e ON e.src = v.node),
walk(node, k, cur) AS (
  SELECT node, 0, node FROM succ
  UNION ALL
  SELECT w.node, w.k + 1, s.nxt FROM walk w JOIN succ s ON s.node = w.cur
  WHERE w.k < (SELECT count(*) FROM succ)),
cyc AS (SELECT DISTINCT w.node FROM walk w JOIN succ s ON s.node = w.node
        WHERE w.k > 0 AND w.cur = w.node AND NOT s.is_sink),
lab AS (SELECT w.node, min(w.cur) AS cycle FROM walk w JOIN cyc USING (node) GROUP BY w.node),
insum AS (SELECT dst AS node, sum(sim) AS in_sum FROM e GROUP BY dst),
"""


def _stars_sql(combine: str, anchor: str) -> str:
    if anchor == "min_id":
        pick = "SELECT cycle, min(node) AS anchor FROM lab GROUP BY cycle"
    else:
        pick = ("SELECT cycle, node AS anchor FROM (SELECT l.cycle, l.node, row_number() OVER (PARTITION BY l.cycle "
                "ORDER BY round(coalesce(i.in_sum, 0.0), 9) DESC, l.node) AS rn FROM lab l LEFT JOIN insum i USING (node)) "
                "WHERE rn = 1")
    comb = "least(r.acc, s.w)" if combine == "min" else "r.acc * s.w"
    return f"""WITH RECURSIVE {GRAPH_SQL}
anchors AS (SELECT anchor AS node FROM ({pick}) UNION SELECT node FROM succ WHERE is_sink),
res(node, cur, acc) AS (
  SELECT node, node, 1.0::DOUBLE FROM succ
  UNION ALL
  SELECT r.node, s.nxt, {comb} FROM res r JOIN succ s ON s.node = r.cur
  WHERE r.cur NOT IN (SELECT node FROM anchors))
SELECT node, cur AS anchor, round(acc, 6) AS sim, node = cur AS is_anchor
FROM res WHERE cur IN (SELECT node FROM anchors)"""


def _make(combine: str, anchor: str):
    def q(spark, sf):
        edges, nodes = customer_graph(spark, sf)
        out = G.star_decompose(edges, nodes, combine=combine, cycle_anchor=anchor)
        return out.select("node", "anchor", F.round("sim", 6).alias("sim"), "is_anchor")
    q.__name__ = f"q_stars_{combine}_{anchor}"
    return q


for _name, _comb, _anchor, _ops in (
        ("functional_graph_stars_min", "min", "max_in_sum", "I1 I2 I3 I4 I6 I7 I9 G3 G4 H7"),
        ("functional_graph_stars_product", "product", "max_in_sum", "I4 I6 I8 I9"),
        ("functional_graph_stars_min_id", "min", "min_id", "I5 I6 I7 I9")):
    register(_name, _ops, (lambda c, a: lambda: _stars_sql(c, a))(_comb, _anchor))(_make(_comb, _anchor))


@register("star_partition", "I10", lambda: (
    f"SELECT count(*) AS nodes, count(DISTINCT node) AS distinct_nodes, count(DISTINCT anchor) AS clusters "
    f"FROM ({_stars_sql('min', 'max_in_sum')})"))
def q_star_partition(spark, sf):
    edges, nodes = customer_graph(spark, sf)
    out = G.star_decompose(edges, nodes)
    return out.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("node").alias("distinct_nodes"),
                   F.count_distinct("anchor").alias("clusters"))


@register("nested_clusters", "A15 G10 H4", lambda: (
    f"WITH s AS (SELECT * FROM ({_stars_sql('min', 'max_in_sum')})) SELECT anchor, node AS member, sim FROM s WHERE NOT is_anchor "
    f"UNION ALL SELECT anchor, NULL, NULL FROM s WHERE is_anchor AND node NOT IN (SELECT anchor FROM s WHERE NOT is_anchor)"))
def q_nested_clusters(spark, sf):
    edges, nodes = customer_graph(spark, sf)
    out = G.star_decompose(edges, nodes)
    return G.star_sink(out.withColumn("sim", F.round("sim", 6)))
