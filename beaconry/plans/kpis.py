"""KPI monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.operators import kpi as K
from beaconry.plans.oracle_views import add_view
from beaconry.plans.registry import query
from beaconry.sources import bindings as B

add_view("kpi_long", """
    SELECT day, 'revenue' AS metric_name, CAST(revenue AS DOUBLE) AS value FROM daily_kpi
    UNION ALL SELECT day, 'orders', CAST(orders AS DOUBLE) FROM daily_kpi
    UNION ALL SELECT day, 'conversion', CAST(orders AS DOUBLE) / nullif(visits, 0) FROM daily_kpi""")
add_view("kpi_based", """
    WITH b AS (SELECT *, AVG(value) OVER (PARTITION BY metric_name ORDER BY day
                      RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS baseline FROM kpi_long)
    SELECT *, (value - baseline) / baseline * 100 AS pct, coalesce(abs((value - baseline) / baseline * 100) > 20, FALSE) AS flag FROM b""")


def _history(t):
    return K.to_history(B.daily_kpi(t))


@query("kpi_core", """
    SELECT round(SUM(revenue), 2) AS revenue_total, round(AVG(revenue), 4) AS avg_order_value,
           round(SUM(orders) / SUM(visits), 6) AS conversion_rate FROM daily_kpi""")
def _core(t):
    return K.core(B.daily_kpi(t)).select(
        F.round("revenue_total", 2).alias("revenue_total"), F.round("avg_order_value", 4).alias("avg_order_value"),
        F.round("conversion_rate", 6).alias("conversion_rate"))


@query("kpi_history", """
    SELECT day, metric_name, round(value, 6) AS value, round(baseline, 6) AS baseline, flag AS anomaly_flag FROM kpi_based""")
def _kpi_history(t):
    return K.with_baseline(_history(t)).select(
        "day", "metric_name", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), "anomaly_flag")


@query("kpi_baseline_pct", "SELECT day, metric_name, round(pct, 4) AS change_pct FROM kpi_based WHERE baseline IS NOT NULL")
def _baseline(t):
    return K.with_baseline(_history(t)).where("baseline is not null").select(
        "day", "metric_name", F.round("change_pct", 4).alias("change_pct"))


@query("kpi_zscore", """
    WITH s AS (SELECT metric_name, arg_max(value, day) AS latest, AVG(value) AS m, stddev_samp(value) AS sd FROM kpi_long GROUP BY 1)
    SELECT metric_name, round(latest, 6) AS latest, round((latest - m) / sd, 6) AS z_score,
           coalesce(abs((latest - m) / sd) > 3, FALSE) AS is_anomaly FROM s""")
def _zscore(t):
    return K.z_scores(_history(t)).select(
        "metric_name", F.round("latest", 6).alias("latest"), F.round("z_score", 6).alias("z_score"), "is_anomaly")


@query("repeat_anomaly", """
    WITH f AS (SELECT *, lag(flag) OVER (PARTITION BY metric_name ORDER BY day) AS before FROM kpi_based)
    SELECT metric_name, day, CASE WHEN before THEN 'unresolved' ELSE 'new' END AS state FROM f WHERE flag""")
def _repeat(t):
    return K.repeated(K.with_baseline(_history(t)))


@query("seasonal_check", """
    WITH s AS (SELECT *, AVG(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM kpi_long
               WINDOW w AS (PARTITION BY metric_name, dayofweek(day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT metric_name, day, round((value - m) / nullif(sd, 0), 4) AS z_score,
           coalesce(abs((value - m) / nullif(sd, 0)) > 3, FALSE) AS is_anomaly FROM s""")
def _seasonal(t):
    return K.seasonal(_history(t)).select("metric_name", "day", F.round("z_score", 4).alias("z_score"), "is_anomaly")


def sales_facts(t):
    """Revenue by region, part, quarter and side of the cut, joined to the part's category after it is summed.

    Lines meet their orders first: that shuffle is needed anyway, and what is summed behind it is one row for each mix.
    """
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("r_name").alias("region"))
    buyers = t.customer.select("c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "region")
    orders = t.orders.select("o_orderkey", "o_custkey", F.quarter("o_orderdate").alias("period"), (
        F.col("o_orderdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).alias("is_current")).join(
        buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "region", "period", "is_current")
    lines = t.lineitem.select("l_orderkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    sold = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        "region", "l_partkey", "period", "is_current").agg(F.sum("revenue").alias("revenue"))
    parts = t.part.select("p_partkey", F.col("p_type").alias("product"))
    return sold.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("region", "product", "period", "is_current", "revenue")


def causes(t):
    out = K.root_cause(sales_facts(t), ["region", "product", "period"], "revenue", F.col("is_current"))
    return out.withColumns({c: F.round(c, 4) for c in ("current_amount", "earlier_amount", "delta")})


_CAUSES_SQL = """
    SELECT coalesce(r_name, 'ALL') AS region, coalesce(p_type, 'ALL') AS product,
           coalesce(CAST(quarter(o_orderdate) AS VARCHAR), 'ALL') AS period,
           round(SUM(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 4) AS current_amount,
           round(SUM(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 0 ELSE l_extendedprice * (1 - l_discount) END), 4) AS earlier_amount,
           round(SUM(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 1 ELSE -1 END * l_extendedprice * (1 - l_discount)), 4) AS delta
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
    GROUP BY CUBE (r_name, p_type, quarter(o_orderdate))"""


@query("root_cause", _CAUSES_SQL)
def _root_cause(t):
    return causes(t)


@query("kpi_findings", f"""
    WITH s AS (SELECT metric_name, arg_max(value, day) AS latest, AVG(value) AS m, stddev_samp(value) AS sd FROM kpi_long GROUP BY 1),
         c AS ({_CAUSES_SQL})
    SELECT region, product, period, delta, metric_name, round((latest - m) / sd, 6) AS z_score FROM s, c WHERE abs((latest - m) / sd) > 0.5""")
def _findings(t):
    return K.findings(B.daily_kpi(t), causes(t), limit=0.5).select(
        "region", "product", "period", "delta", "metric_name", F.round("z_score", 6).alias("z_score"))
