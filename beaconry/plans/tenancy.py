"""Tenant routing, metering and invoicing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.operators import tenants as T
from beaconry.plans.oracle_views import add_view
from beaconry.plans.registry import query
from beaconry.sources import bindings as B

_SHARE = "(CAST(('0x' || substr(md5(CAST(request_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"

add_view("routed", f"""
    SELECT r.*, g.stable_model, g.canary_model,
           coalesce(g.canary_model IS NOT NULL AND g.canary_weight > 0 AND {_SHARE} < g.canary_weight, FALSE) AS is_canary
    FROM requests r LEFT JOIN tenant_registry g ON r.tenant_id = g.tenant_id""")


@query("tenant_route", """
    SELECT request_id, tenant_id, CASE WHEN is_canary THEN canary_model ELSE stable_model END AS model,
           CASE WHEN stable_model IS NULL THEN 'unknown_tenant' WHEN is_canary THEN 'canary' ELSE 'stable' END AS route
    FROM routed""")
def _route(t):
    return T.route(B.requests(t), B.tenant_registry(t)).select("request_id", "tenant_id", "model", "route")


@query("canary_split", """
    SELECT tenant_id, COUNT(*) AS n, SUM(is_canary::INT)::BIGINT AS n_canary FROM routed
    WHERE stable_model IS NOT NULL GROUP BY tenant_id""")
def _canary(t):
    routed = T.route(B.requests(t), B.tenant_registry(t)).where("route <> 'unknown_tenant'")
    return routed.groupBy("tenant_id").agg(F.count("*").alias("n"), F.count_if(F.col("route") == "canary").alias("n_canary"))


add_view("valid_changes", """
    SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY changed_at DESC, change_id DESC) AS newest,
           lag(action) OVER (PARTITION BY tenant_id ORDER BY changed_at, change_id) AS before
    FROM tenant_changes WHERE action = 'deregister' OR canary_weight BETWEEN 0 AND 1""")


@query("tenant_register", """
    SELECT tenant_id, change_id, canary_weight FROM tenant_changes
    WHERE action = 'register' AND NOT canary_weight BETWEEN 0 AND 1""")
def _register(t):
    return T.rejected_changes(B.tenant_changes(t)).select("tenant_id", "change_id", "canary_weight")


@query("tenant_list", """
    SELECT tenant_id, stable_model, canary_model, canary_weight FROM valid_changes WHERE newest = 1 AND action = 'register'""")
def _list(t):
    return T.current_registry(B.tenant_changes(t))


@query("tenant_deregister", """
    SELECT tenant_id, change_id, CASE WHEN before = 'register' THEN 'removed' ELSE 'not_found' END AS outcome
    FROM valid_changes WHERE action = 'deregister'""")
def _deregister(t):
    return T.deregistrations(B.tenant_changes(t))


def usage_events(t):
    return B.requests(t).select("request_id", "tenant_id", "ts", F.floor("value").cast("int").alias("count"))


add_view("usage_events", "SELECT request_id, tenant_id, ts, CAST(floor(value) AS INT) AS cnt FROM requests")
add_view("usage_counts", "SELECT tenant_id, SUM(cnt)::BIGINT AS calls FROM usage_events WHERE cnt >= 1 GROUP BY 1")


@query("usage_count", """
    SELECT g.tenant_id, coalesce(u.calls, 0)::BIGINT AS calls
    FROM tenant_registry g LEFT JOIN usage_counts u ON g.tenant_id = u.tenant_id""")
def _usage(t):
    return T.usage_of(B.tenant_registry(t), T.usage(usage_events(t), "tenant_id"))


@query("invoice_flat", """
    SELECT tenant_id, calls, round(calls * 0.002::DOUBLE, 4) AS amount FROM usage_counts
    UNION ALL SELECT 'ALL', SUM(calls)::BIGINT, round(SUM(round(calls * 0.002::DOUBLE, 4)), 4) FROM usage_counts""")
def _invoice(t):
    return T.invoices(T.usage(usage_events(t), "tenant_id"))


@query("invoice_tiered", """
    SELECT tenant_id, calls * 40 AS calls,
           round(least(calls * 40, 10000)::DOUBLE * 0.003 + greatest(least(calls * 40, 100000)::DOUBLE - 10000, 0) * 0.002
                 + greatest((calls * 40)::DOUBLE - 100000, 0) * 0.001, 4) AS amount
    FROM usage_counts""")
def _tiered(t):
    counted = T.usage(usage_events(t), "tenant_id").select("tenant_id", (F.col("calls") * 40).alias("calls"))
    return counted.withColumn("amount", T.tiered_price(F.col("calls")))


@query("usage_reset", """
    SELECT tenant_id, CAST(date_trunc('week', ts) AS DATE) AS period, SUM(cnt)::BIGINT AS calls
    FROM usage_events WHERE cnt >= 1 GROUP BY 1, 2""")
def _reset(t):
    weekly = usage_events(t).withColumn("period", F.to_date(F.date_trunc("week", "ts")))
    return T.usage(weekly, "tenant_id", "period")


# Every hundredth event resets the tenant of its request, and one moment resets all.
@query("usage_reset_tenant", """
    WITH r AS (SELECT tenant_id, ts AS "at" FROM usage_events WHERE request_id % 100 = 7 AND ts < TIMESTAMP '2024-01-20'
               UNION ALL SELECT NULL, TIMESTAMP '2024-01-03'),
         l AS (SELECT u.*, greatest((SELECT MAX("at") FROM r WHERE r.tenant_id = u.tenant_id),
                                    (SELECT MAX("at") FROM r WHERE tenant_id IS NULL)) AS since FROM usage_events u)
    SELECT tenant_id, coalesce(SUM(CASE WHEN ts > since THEN cnt END), 0)::BIGINT AS calls FROM l WHERE cnt >= 1 GROUP BY 1""")
def _reset_tenant(t):
    events = usage_events(t)
    own = events.where((F.col("request_id") % 100 == 7) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))).select(
        "tenant_id", F.col("ts").alias("at"))
    every = t.spark.range(1).select(F.lit(None).cast("string").alias("tenant_id"),
                                    F.lit("2024-01-03").cast("timestamp_ntz").alias("at"))
    return T.usage_since_reset(events, own.union(every))


@query("billing_snapshot", """
    SELECT g.tenant_id, g.stable_model, coalesce(u.calls, 0)::BIGINT AS predictions,
           round(coalesce(u.calls, 0) * 0.002::DOUBLE, 4) AS invoice
    FROM tenant_registry g LEFT JOIN usage_counts u ON g.tenant_id = u.tenant_id""")
def _snapshot(t):
    registry = B.tenant_registry(t)
    calls = T.usage_of(registry, T.usage(usage_events(t), "tenant_id"))
    return registry.join(calls, "tenant_id").select(
        "tenant_id", "stable_model", F.col("calls").alias("predictions"), T.flat_price(F.col("calls")).alias("invoice"))
