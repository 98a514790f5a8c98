"""Revenue monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions import scalars as S
from beaconry.operators import revenue as R
from beaconry.plans.oracle_views import add_view
from beaconry.plans.registry import query
from beaconry.session import stored
from beaconry.sources import bindings as B

AS_OF = "2024-01-31 12:00:00"
_NOW = f"TIMESTAMP '{AS_OF}'"


def sources(t):
    deals = B.crm_deals(t).select(
        F.col("account_id").cast("string").alias("crm_account"), F.col("amount").alias("deal_amount"), "deal_stage",
        "created_at", (F.col("created_at") + F.expr("make_dt_interval(cast(account_id % 90 as int))")).alias("close_at"),
        F.col("created_at").alias("modified_at"))
    charges = B.billing_charges(t).select(F.col("account_id").cast("string").alias("customer"), "amount",
                                          F.col("created_at").alias("last_activity_at"))
    usage = B.account_analytics(t).select(
        F.col("account_id").cast("string").alias("account_id"), "total_revenue", "churn_risk_score")
    campaigns = t.events.where("event_type = 'click'").select(
        F.lit("").alias("crm_account"), F.col("user_id").cast("string").alias("customer"),
        F.lit("").alias("deal_stage"), F.col("ts").alias("modified_at"))
    return R.union_sources(crm=deals, billing=charges, analytics=usage, marketing=campaigns)


add_view("unified", f"""
    SELECT 'crm' AS data_source, CAST(account_id AS VARCHAR) AS account_id, amount AS revenue_amount, deal_stage,
           created_at + to_days(CAST(account_id % 90 AS INT)) AS close_date, 0.0::DOUBLE AS risk_score,
           CAST(floor(epoch({_NOW} - created_at) / 86400) AS INT) AS days_in_stage,
           amount / greatest(1, account_id % 90) AS revenue_velocity FROM crm_deals
    UNION ALL SELECT 'billing', CAST(account_id AS VARCHAR), amount, 'unknown', created_at, 0, 0, 0 FROM billing_charges
    UNION ALL SELECT 'analytics', CAST(account_id AS VARCHAR), total_revenue, 'unknown', NULL, churn_risk_score, 0, 0 FROM account_analytics
    UNION ALL SELECT 'marketing', CAST(user_id AS VARCHAR), 0, 'unknown', NULL, 0, CAST(floor(epoch({_NOW} - ts) / 86400) AS INT), 0
    FROM events WHERE event_type = 'click'""")
_SEV = """CASE WHEN revenue_amount > 400000 THEN 'critical' WHEN revenue_amount > 250000 THEN 'high'
          WHEN revenue_amount > 100000 THEN 'medium' ELSE 'low' END"""
add_view("insights", f"""
    SELECT 'revenue_leak' AS category, {_SEV} AS severity, account_id, 'open deal without movement' AS description,
           'contact the account owner' AS recommended_action, revenue_amount AS impact FROM unified
    WHERE deal_stage = 'O' AND days_in_stage > 1000 AND revenue_amount > 100000
    UNION ALL SELECT 'high_probability', {_SEV}, account_id, 'deal moves fast', 'put a senior seller on it', revenue_amount
    FROM unified WHERE revenue_velocity > 300
    UNION ALL SELECT 'pipeline_risk', CASE WHEN risk_score >= 0.9 THEN 'critical' WHEN risk_score >= 0.8 THEN 'high' ELSE 'medium' END,
           account_id, 'account may leave', 'plan a retention call', revenue_amount FROM unified WHERE risk_score >= 0.7""")


def _insights(t):
    return R.rule_insights(R.unify(sources(t), AS_OF))


@query("src_sql_recent", """
    SELECT event_id, user_id, event_type, value, ts FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'""")
def _recent(t):
    day = F.date_sub(F.lit("2024-01-31").cast("date"), 7).cast("timestamp_ntz")
    return t.events.where(F.col("ts") >= day).select("event_id", "user_id", "event_type", "value", "ts")


@query("src_erp", """
    SELECT 'vendor' AS feed, COUNT(*) AS n, round(SUM(total_spend), 2) AS amount FROM vendor_spend
    UNION ALL SELECT 'contract', COUNT(*), NULL FROM contracts
    UNION ALL SELECT 'invoice', COUNT(*), round(SUM(amount), 2) FROM invoices
    UNION ALL SELECT 'benchmark', COUNT(*), NULL FROM market_benchmarks
    UNION ALL SELECT 'revenue', COUNT(*), round(SUM(revenue), 2) FROM monthly_finance""")
def _erp(t):
    spend = stored(B.vendor_spend(t), "spend")

    def feed(name, df, amount=None):
        total = F.round(F.sum(amount), 2) if amount else F.lit(None).cast("double")
        return df.agg(F.count("*").alias("n"), total.alias("amount")).select(F.lit(name).alias("feed"), "n", "amount")

    parts = [feed("vendor", spend, "total_spend"), feed("contract", B.contracts(t)), feed("invoice", B.invoices(t), "amount"),
             feed("benchmark", B.market_benchmarks(spend)), feed("revenue", B.monthly_finance(t), "revenue")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("union_sources", "SELECT data_source, COUNT(*) AS n, round(SUM(revenue_amount), 2) AS amount FROM unified GROUP BY 1")
def _union(t):
    amount = F.coalesce("deal_amount", "amount", "total_revenue", F.lit(0.0))
    return sources(t).groupBy("data_source").agg(F.count("*").alias("n"), F.round(F.sum(amount), 2).alias("amount"))


@query("unify_features", """
    SELECT data_source, account_id, revenue_amount, deal_stage, close_date, risk_score, days_in_stage,
           revenue_velocity FROM unified""")
def _unify(t):
    return R.unify(sources(t), AS_OF)


@query("falsy_coalesce", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 2 = 0 THEN props ELSE 'unknown' END AS picked,
           CASE WHEN event_id % 2 = 0 THEN value ELSE CAST(user_id AS DOUBLE) END AS amount FROM events""")
def _falsy(t):
    k = F.col("event_id")
    first = F.when(k % 3 == 0, F.col("event_type")).otherwise("")
    second = F.when(k % 2 == 0, F.col("props"))
    number = F.when(k % 2 == 0, F.col("value")).when(k % 3 == 0, 0.0).otherwise(float("nan"))
    return t.events.select("event_id", S.falsy_text(first, second, default="unknown").alias("picked"),
                           S.falsy_number(number, F.col("user_id")).alias("amount"))


@query("days_in_stage", f"""
    SELECT event_id, CAST(floor(epoch({_NOW} - ts) / 86400) AS INT) AS days FROM events""")
def _days(t):
    return t.events.select("event_id", S.floor_days(F.lit(AS_OF).cast("timestamp_ntz"), F.col("ts")).alias("days"))


@query("revenue_velocity", """
    SELECT account_id, deal_stage, COUNT(*) AS deals, round(SUM(revenue_velocity), 8) AS velocity FROM unified
    WHERE data_source = 'crm' GROUP BY 1, 2""")
def _velocity(t):
    return R.unify(sources(t), AS_OF).where("data_source = 'crm'").groupBy("account_id", "deal_stage").agg(
        F.count("*").alias("deals"), F.round(F.sum("revenue_velocity"), 8).alias("velocity"))


@query("rule_insights", "SELECT category, severity, account_id, description, recommended_action, round(impact, 2) AS impact FROM insights")
def _rules(t):
    return _insights(t).drop("data_source").withColumn("impact", F.round("impact", 2))


@query("insight_route", """
    SELECT CASE category WHEN 'revenue_leak' THEN 'sales_alert' WHEN 'high_probability' THEN 'sales_priority'
           ELSE 'executive_alert' END AS branch, severity, COUNT(*) AS n FROM insights GROUP BY 1, 2""")
def _route(t):
    return R.route(_insights(t)).groupBy("branch", "severity").agg(F.count("*").alias("n"))


@query("insight_alert", """
    SELECT category, account_id, printf('* %s. Action: %s. Impact: %.2f', description, recommended_action, impact) AS line, impact
    FROM insights WHERE severity = 'critical' OR (category = 'high_probability' AND severity = 'high')""")
def _alert(t):
    return R.alert_lines(_insights(t))


@query("insight_alert_totals", """
    SELECT category, COUNT(DISTINCT account_id) AS accounts, round(SUM(impact), 2) AS impact FROM insights GROUP BY 1""")
def _alert_totals(t):
    return R.alert_totals(_insights(t))


@query("insight_report", """
    SELECT coalesce(category, 'ALL') AS category, COUNT(*) AS insights, round(SUM(abs(impact)), 2) AS total_impact,
           SUM((severity = 'critical')::INT)::BIGINT AS critical FROM insights GROUP BY ROLLUP (category)""")
def _report(t):
    return R.report(_insights(t))


@query("sink_crm_updates", """
    SELECT account_id, category, CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 75 ELSE 50 END AS priority_score,
           description AS insight, recommended_action FROM insights""")
def _crm(t):
    return R.crm_updates(_insights(t))


@query("src_crm_limit", """
    SELECT account_id, amount, deal_stage, created_at FROM crm_deals""")
def _crm_limit(t):
    return B.crm_deals(t).select("account_id", "amount", "deal_stage", "created_at")
