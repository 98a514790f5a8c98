"""Domain tables bound to the shared Parquet tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.sources.tables import Tables

# English questions that exercise every intent and every sensitive topic.
SAMPLE_QUESTIONS = (
    (1, "How many vacation days and how much parental leave do I get?"),
    (2, "Does the dental insurance cover vision and health checks?"),
    (3, "When is the bonus part of my salary paid, and is there equity?"),
    (4, "Which code of conduct and ethics rules apply to a complaint?"),
    (5, "How is the performance review linked to promotion and goals?"),
    (6, "Where do I pick up my laptop and badge on the first day?"),
    (7, "What notice do I give if I resign, and is there severance?"),
    (8, "I want to report harassment by a colleague."),
    (9, "Do I need a lawyer after a wrongful termination?"),
    (10, "Can I get an accommodation for anxiety?"),
    (11, "How do I open a salary negotiation?"),
    (12, "I plan to report manager misuse of funds."),
    (13, "What is the weather like?"),
    (14, "Is unused PTO paid out after my last day?"),
)


def transactions(t: Tables, spread: bool = False) -> DataFrame:
    """Order lines as card transactions; ``spread`` deals a table of few files out to all cores."""
    lines = t.spread("lineitem") if spread else t.lineitem
    return lines.select(
        "l_orderkey", "l_linenumber",
        F.col("l_extendedprice").alias("transaction_amount"),
        (F.col("l_suppkey") * 20).cast("double").alias("account_age"),
        F.col("l_quantity").alias("num_transactions"),
        F.col("l_discount").alias("merchant_risk"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(F.col("l_shipdate") < F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"), "baseline")
        .otherwise("current").alias("side"),
    )


def requests(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("request_id"), "ts",
        F.concat(F.lit("tenant_"), F.col("user_id").cast("string")).alias("tenant_id"),
        "event_type", "value",
    )


def tenant_registry(t: Tables) -> DataFrame:
    """One tenant per customer outside the MACHINERY segment; the others are unknown tenants."""
    model = F.lower(F.col("c_mktsegment"))
    return t.customer.where(F.col("c_mktsegment") != "MACHINERY").select(
        F.concat(F.lit("tenant_"), F.col("c_custkey").cast("string")).alias("tenant_id"),
        F.concat(model, F.lit("_v1")).alias("stable_model"),
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(model, F.lit("_v2"))).alias("canary_model"),
        ((F.col("c_nationkey") % 5).cast("double") / 10).alias("canary_weight"),
    )


def tenant_changes(t: Tables) -> DataFrame:
    """Registration log: every order re-registers its customer, an order in status P removes it."""
    return t.orders.select(
        F.concat(F.lit("tenant_"), F.col("o_custkey").cast("string")).alias("tenant_id"),
        F.col("o_orderkey").alias("change_id"), F.col("o_orderdate").alias("changed_at"),
        F.when(F.col("o_orderstatus") == "P", "deregister").otherwise("register").alias("action"),
        F.concat(F.lit("model_"), (F.col("o_orderkey") % 7).cast("string")).alias("stable_model"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("model_next")).alias("canary_model"),
        ((F.col("o_orderkey") % 13).cast("double") / 10).alias("canary_weight"),
    )


def predictions(t: Tables) -> DataFrame:
    docs = t.documents.select(
        "doc_id", F.when(F.col("n_chars").between(200, 5000), 1).otherwise(0).alias("prediction"))
    return t.labels.select("doc_id", F.col("quality").alias("actual")).join(docs, "doc_id")


def metrics_history(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(
        F.avg(F.when(F.col("event_type") != "error", F.lit(1.0)).otherwise(F.lit(0.0))).alias("accuracy"),
        F.count("*").alias("total_predictions"),
    )


def vendor_spend(t: Tables) -> DataFrame:
    """Spend per vendor and category; lines are summed per (vendor, part) before the joins."""
    lines = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(
        F.sum("l_extendedprice").alias("spend"), F.sum("l_quantity").alias("volume"))
    parts = t.part.select("p_partkey", F.col("p_type").alias("category"))
    by_vendor = (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("l_suppkey", "category")
        .agg(F.sum("spend").alias("total_spend"), F.sum("volume").alias("total_volume"))
    )
    names = t.supplier.select("s_suppkey", F.col("s_name").alias("vendor_name"))
    return by_vendor.join(names, by_vendor.l_suppkey == names.s_suppkey).select(
        F.col("l_suppkey").alias("vendor_id"), "vendor_name", "category", "total_spend", "total_volume",
        (F.col("total_spend") / F.col("total_volume")).alias("average_price"),
    )


def market_benchmarks(spend: DataFrame) -> DataFrame:
    return spend.where(F.col("category") != "PROMO").groupBy("category").agg(
        F.avg("average_price").alias("market_price"),
        (F.avg("total_volume") * 1.2).alias("high_volume_threshold"),
    )


def contracts(t: Tables) -> DataFrame:
    return t.supplier.where(F.col("s_suppkey") % 10 != 7).select(
        F.col("s_suppkey").alias("vendor_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("s_suppkey") * 37) % 200 - 30).cast("int"))
        .alias("expiry_date"),
        ((F.col("s_suppkey") % 3) * 30).cast("int").alias("payment_terms_days"),
    )


def invoices(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("vendor_id"), F.col("l_orderkey").alias("order_key")).agg(
        F.sum("l_extendedprice").alias("amount"))


def monthly_finance(t: Tables) -> DataFrame:
    """One row per calendar month; lines are summed per order before the join."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.sum(F.col("l_extendedprice") * (0.6 + F.col("l_discount"))).alias("expenses"),
        F.sum(F.col("l_extendedprice") * F.col("l_tax") * 3).alias("payroll"),
    )
    dated = t.orders.select("o_orderkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("period"))
    return per_order.join(dated, per_order.l_orderkey == dated.o_orderkey).groupBy("period").agg(
        F.sum("revenue").alias("revenue"), F.sum("expenses").alias("expenses"), F.sum("payroll").alias("payroll"))


def employees(t: Tables) -> DataFrame:
    key, seg = F.col("c_custkey"), F.col("c_mktsegment")
    return t.customer.select(
        key.alias("employee_id"), F.col("c_name").alias("employee_name"),
        F.when(seg == "AUTOMOBILE", "Senior Software Engineer").when(seg == "BUILDING", "Team Lead")
        .when(seg == "FURNITURE", "Account Executive").when(seg == "MACHINERY", "Finance Analyst")
        .otherwise("Designer").alias("role"),
        F.when(key % 5 == 0, "manager").when(key % 5 == 1, "director").otherwise("individual_contributor")
        .alias("level"),
        F.date_add(F.lit("2023-06-01").cast("date"), (key % 400).cast("int")).alias("start_date"),
        (50000 + 1000 * (key % 150)).cast("double").alias("salary"),
        (key % 13).cast("double").alias("contribution_pct"),
        (key % 9).cast("double").alias("pto_used"),
        F.when(key % 6 == 0, "part_time_80").when(key % 6 == 1, "part_time_60").when(key % 6 == 2, "part_time_50")
        .when(key % 6 == 3, "contractor").otherwise("full_time").alias("employment_type"),
        F.when(key % 4 == 0, "PPO").when(key % 4 == 1, "HMO").when(key % 4 == 2, "HDHP").otherwise("EPO")
        .alias("plan_name"),
        F.when(key % 3 == 0, "employee_only").when(key % 3 == 1, "family").otherwise("unlisted_tier")
        .alias("coverage_tier"),
    )


def crm_deals(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("account_id"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("deal_stage"), F.col("o_orderdate").alias("created_at"))


def billing_charges(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("account_id"), F.col("value").alias("amount"), F.col("ts").alias("created_at"))


def account_analytics(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("account_id"), F.col("c_acctbal").alias("total_revenue"),
        ((F.col("c_custkey") % 101).cast("double") / 100).alias("churn_risk_score"))


def questions(t: Tables) -> DataFrame:
    """User turns of the conversations, joined by the fixed sample as conversation -1."""
    asked = t.conversations.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    sample = t.spark.createDataFrame(
        [(-1, i, q) for i, q in SAMPLE_QUESTIONS], "conv_id bigint, turn bigint, question string")
    return asked.unionByName(sample)


def daily_kpi(t: Tables) -> DataFrame:
    def hit(kind: str, amount) -> object:
        return F.sum(F.when(F.col("event_type") == kind, amount).otherwise(F.lit(0)))

    return t.events.groupBy(F.to_date("ts").alias("day")).agg(
        hit("purchase", F.col("value")).alias("revenue"),
        hit("purchase", F.lit(1)).alias("orders"),
        hit("view", F.lit(1)).alias("visits"),
    )
