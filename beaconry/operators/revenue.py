"""Revenue monitoring: source union, normalised features, rule insights, alerts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.functions.scalars import falsy_number, falsy_text, floor_days, severity_score

# Our own rules in place of a language model; every limit can be changed by the caller.
STALLED_DAYS, LEAK_AMOUNT, FAST_VELOCITY, RISKY_SCORE = 1_000, 100_000.0, 300.0, 0.7
CRITICAL_AMOUNT, HIGH_AMOUNT, MEDIUM_AMOUNT = 400_000.0, 250_000.0, 100_000.0
REPORT_CATEGORIES = ("revenue_leak", "high_probability", "pipeline_risk")
ALERT_SEVERITIES = {
    "revenue_leak": ("critical",), "high_probability": ("critical", "high"), "pipeline_risk": ("critical",)}


def union_sources(**sources: DataFrame) -> DataFrame:
    """Append sources of different shape; absent columns are null and ``data_source`` names the origin."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn("data_source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def unify(rows: DataFrame, as_of: str) -> DataFrame:
    """Eight normalised columns; null, 0 and the empty text all fall through to the next choice."""
    names = set(rows.columns)

    def col(name: str):
        return F.col(name) if name in names else F.lit(None)

    now = F.lit(as_of).cast("timestamp_ntz")
    modified = F.coalesce(col("modified_at").cast("timestamp_ntz"), now)
    closed, created = (F.coalesce(col(c).cast("timestamp_ntz"), now) for c in ("close_at", "created_at"))
    open_days = F.greatest(F.lit(1), floor_days(closed, created))
    return rows.select(
        falsy_text(col("data_source"), default="unknown").alias("data_source"),
        falsy_text(col("crm_account"), col("customer"), col("account_id")).alias("account_id"),
        falsy_number(col("deal_amount"), col("amount"), col("total_revenue")).alias("revenue_amount"),
        falsy_text(col("deal_stage"), default="unknown").alias("deal_stage"),
        F.coalesce(col("close_at").cast("timestamp_ntz"), col("last_activity_at").cast("timestamp_ntz")).alias("close_date"),
        falsy_number(col("churn_risk_score")).alias("risk_score"),
        floor_days(now, modified).alias("days_in_stage"),
        (falsy_number(col("deal_amount")) / open_days).alias("revenue_velocity"))


def rule_insights(features: DataFrame) -> DataFrame:
    """Insight rows (category, severity, account, impact) found by explicit rules."""
    amount = F.col("revenue_amount")
    by_amount = (F.when(amount > CRITICAL_AMOUNT, "critical").when(amount > HIGH_AMOUNT, "high")
                 .when(amount > MEDIUM_AMOUNT, "medium").otherwise("low"))
    by_risk = F.when(F.col("risk_score") >= 0.9, "critical").when(F.col("risk_score") >= 0.8, "high").otherwise("medium")

    def insight(on, category, severity, text, action):
        return F.when(on, F.struct(
            F.lit(category).alias("category"), severity.alias("severity"), F.col("account_id").alias("account_id"),
            F.lit(text).alias("description"), F.lit(action).alias("recommended_action"), amount.alias("impact")))

    stalled = (F.col("deal_stage") == "O") & (F.col("days_in_stage") > STALLED_DAYS) & (amount > LEAK_AMOUNT)
    found = F.array_compact(F.array(
        insight(stalled, "revenue_leak", by_amount, "open deal without movement", "contact the account owner"),
        insight(F.col("revenue_velocity") > FAST_VELOCITY, "high_probability", by_amount, "deal moves fast", "put a senior seller on it"),
        insight(F.col("risk_score") >= RISKY_SCORE, "pipeline_risk", by_risk, "account may leave", "plan a retention call")))
    return features.select("data_source", F.inline(found))


def route(insights: DataFrame) -> DataFrame:
    """Insights of the three report branches, tagged with the branch that handles them."""
    branch = (F.when(F.col("category") == "revenue_leak", "sales_alert")
              .when(F.col("category") == "high_probability", "sales_priority")
              .when(F.col("category") == "pipeline_risk", "executive_alert"))
    return insights.withColumn("branch", branch).where(F.col("branch").isNotNull())


def alert_lines(insights: DataFrame) -> DataFrame:
    """One line per insight that is severe enough for an alert; the table is the message body."""
    hit = None
    for category, severities in ALERT_SEVERITIES.items():
        one = (F.col("category") == category) & F.col("severity").isin(*severities)
        hit = one if hit is None else hit | one
    return insights.where(hit).select(
        "category", "account_id", F.format_string(
            "* %s. Action: %s. Impact: %.2f", "description", "recommended_action", "impact").alias("line"), "impact")


def alert_totals(insights: DataFrame) -> DataFrame:
    """Per category: distinct accounts touched and total impact; sums only, no lists."""
    per_account = insights.groupBy("category", "account_id").agg(F.sum("impact").alias("impact"))
    return per_account.groupBy("category").agg(
        F.count("*").alias("accounts"), F.round(F.sum("impact"), 2).alias("impact"))


def report(insights: DataFrame) -> DataFrame:
    """Counts per category and overall, total absolute impact, critical rows."""
    small = insights.groupBy("category", "severity").agg(
        F.count("*").alias("n"), F.sum(F.abs("impact")).alias("impact"))
    return small.rollup("category").agg(
        F.sum("n").alias("insights"), F.round(F.sum("impact"), 2).alias("total_impact"),
        F.sum(F.when(F.col("severity") == "critical", F.col("n")).otherwise(0)).alias("critical")).select(
        F.coalesce("category", F.lit("ALL")).alias("category"), "insights", "total_impact", "critical")


def crm_updates(insights: DataFrame) -> DataFrame:
    """Update table for the CRM: a priority score, the insight and the action per account row."""
    return insights.select(
        "account_id", "category", severity_score(F.col("severity")).alias("priority_score"),
        F.col("description").alias("insight"), "recommended_action")
