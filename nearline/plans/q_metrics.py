"""Monthly metric queries over ``orders`` / ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as MX
from ..sources.tables import table
from ..operators.selection import exact_median
from .registry import register

HOT_CPU = 20          # E19 threshold (percent)
WINDOW = 2            # ± months


def service_metrics(spark, sf):
    """``(service, year, month, month_key, cpu_percent)``: a priority's share of its month's orders."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("service"),
                                          F.year("o_orderdate").alias("year"),
                                          F.date_format("o_orderdate", "MMM").alias("month"))
    per = o.groupBy("service", "year", "month").agg(F.count(F.lit(1)).alias("n"))
    tot = o.groupBy("year", "month").agg(F.count(F.lit(1)).alias("t"))
    return per.join(tot, ["year", "month"]).select(
        "service", "year", "month", MX.month_key(F.col("year"), F.col("month")).alias("month_key"),
        F.round(F.col("n") * 100.0 / F.col("t")).cast("int").alias("cpu_percent"))


def bills(spark, sf):
    """``(year, month, month_key, cloud_bill_usd)``: total order value per month, in thousands."""
    o = table(spark, sf, "orders")
    b = o.groupBy(F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "MMM").alias("month")) \
        .agg(F.round(F.sum("o_totalprice") / 1000.0, 2).alias("cloud_bill_usd"))
    return b.withColumn("month_key", MX.month_key(F.col("year"), F.col("month")))


METRICS_SQL = """
m AS (SELECT o_orderpriority AS service, year(o_orderdate)::INTEGER AS year, strftime(o_orderdate, '%b') AS month,
             (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INTEGER AS month_key FROM orders),
per AS (SELECT service, year, month, month_key, count(*) AS n FROM m GROUP BY ALL),
tot AS (SELECT year, month, count(*) AS t FROM m GROUP BY ALL),
sm AS (SELECT service, per.year, per.month, month_key, round(n * 100.0 / t)::INTEGER AS cpu_percent
       FROM per JOIN tot ON per.year = tot.year AND per.month = tot.month),
bills AS (SELECT year(o_orderdate)::INTEGER AS year, strftime(o_orderdate, '%b') AS month,
                 (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INTEGER AS month_key,
                 round(sum(o_totalprice) / 1000.0, 2) AS cloud_bill_usd FROM orders GROUP BY ALL)"""


@register("metric_lookup", "F7 B23", f"""WITH {METRICS_SQL},
req AS (SELECT DISTINCT o.o_orderpriority AS service, year(l.l_shipdate)::INTEGER AS year,
               strftime(l.l_shipdate, '%b') AS month
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)
SELECT r.service, r.year, r.month, sm.cpu_percent,
       CASE WHEN sm.cpu_percent IS NULL THEN 'CPU data not found' END AS error
FROM req r LEFT JOIN sm ON sm.service = r.service AND sm.year = r.year AND sm.month = r.month""")
def q_metric_lookup(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    req = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderpriority").alias("service"), F.year("l_shipdate").alias("year"),
        F.date_format("l_shipdate", "MMM").alias("month")).distinct()
    out = MX.lookup(service_metrics(spark, sf), req, ["service", "year", "month"], "cpu_percent", "CPU")
    return out.select("service", "year", "month", "cpu_percent", "error")


@register("hot_services", "E19", f"""WITH {METRICS_SQL}
SELECT service, year, month, cpu_percent FROM sm WHERE cpu_percent > {HOT_CPU}""")
def q_hot_services(spark, sf):
    return MX.hot(service_metrics(spark, sf), "cpu_percent", HOT_CPU).select("service", "year", "month", "cpu_percent")


@register("bill_window", "F8 H8 B24", f"""WITH {METRICS_SQL},
hs AS (SELECT * FROM sm WHERE cpu_percent > {HOT_CPU}),
ex AS (SELECT hs.*, unnest(range(-{WINDOW}, {WINDOW} + 1))::INTEGER AS offset FROM hs)
SELECT ex.service, ex.year, ex.month, ex.offset, b.year AS bill_year, b.month AS bill_month, b.cloud_bill_usd
FROM ex JOIN bills b ON b.month_key = ex.month_key + ex.offset""")
def q_bill_window(spark, sf):
    hs = MX.hot(service_metrics(spark, sf), "cpu_percent", HOT_CPU)
    b = bills(spark, sf).select(F.col("year").alias("bill_year"), F.col("month").alias("bill_month"),
                                "month_key", "cloud_bill_usd")
    w = MX.window_rows(hs, "month_key", b, "month_key", WINDOW)
    return w.select("service", "year", "month", "offset", "bill_year", "bill_month", "cloud_bill_usd")


@register("bill_spikes", "G5 G6", f"""WITH {METRICS_SQL},
hs AS (SELECT * FROM sm WHERE cpu_percent > {HOT_CPU}),
ex AS (SELECT hs.*, unnest(range(-{WINDOW}, {WINDOW} + 1)) AS offset FROM hs),
w AS (SELECT ex.service, ex.year, ex.month, b.cloud_bill_usd FROM ex JOIN bills b ON b.month_key = ex.month_key + ex.offset),
med AS (SELECT service, year, month, median(cloud_bill_usd) AS median, count(cloud_bill_usd) AS n_values FROM w GROUP BY ALL)
SELECT w.service, w.year, w.month, med.median, med.n_values,
       sum((w.cloud_bill_usd >= med.median * {MX.SPIKE_RATIO})::INTEGER)::INTEGER AS n_spikes,
       sum((w.cloud_bill_usd >= med.median * {MX.SPIKE_RATIO})::INTEGER) > 0 AS spike_found,
       CASE WHEN med.n_values = 0 THEN 'no bill values' END AS reason
FROM w JOIN med ON med.service = w.service AND med.year = w.year AND med.month = w.month
GROUP BY w.service, w.year, w.month, med.median, med.n_values""")
def q_bill_spikes(spark, sf):
    hs = MX.hot(service_metrics(spark, sf), "cpu_percent", HOT_CPU)
    b = bills(spark, sf).select("month_key", "cloud_bill_usd")
    w = MX.window_rows(hs, "month_key", b, "month_key", WINDOW)
    return MX.spikes(w, ["service", "year", "month"], "cloud_bill_usd")


@register("explode_metrics", "A14", f"""WITH {METRICS_SQL}
SELECT service, year::VARCHAR AS year, month, cpu_percent FROM sm""")
def q_explode_metrics(spark, sf):
    flat = service_metrics(spark, sf).select("service", F.col("year").cast("string").alias("year"), "month",
                                             "cpu_percent")
    nested = MX.nest(flat, "service", "year", "month", "cpu_percent")
    return MX.explode_nested(nested, "service", "year", "month", "cpu_percent")


@register("exact_medians", "G5", """
SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median, count(l_extendedprice) AS n_values FROM lineitem GROUP BY ALL""",
          note="distributed selection: no group's values meet in one buffer")
def q_exact_medians(spark, sf):
    return exact_median(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
