"""Gates and validation for report records that arrive as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions.scalars import code_map, sanitize_text, score_band, score_clamp

# Limits and enums of a valid report.
MAX_BYTES, MAX_KEYS, MAX_LIST = 65_536, 20, 20
SENTIMENTS = ("positive", "neutral", "negative")
PRIORITIES = ("high", "medium", "low")
SUMMARY_CHARS, METRIC_CHARS, INSIGHT_CHARS, ITEM_CHARS = 1500, 200, 500, 300
MAX_REPORTS_PER_SESSION = 5
SENTIMENT_CODES = {"positive": "up", "neutral": "flat", "negative": "down"}
PRIORITY_CODES = {"high": "red", "medium": "amber", "low": "green"}

REPORT_SCHEMA = (
    "exec_summary string, "
    "key_metrics array<struct<label: string, value: string, delta: string, sentiment: string>>, "
    "insights array<struct<title: string, detail: string, priority: string>>, "
    "data_quality struct<score: string, issues: array<string>, recommendations: array<string>>, "
    "recommended_actions array<string>, risk_flags array<string>, security_alert boolean"
)
INSIGHT_SCHEMA = (
    "revenue_leak_detected boolean, high_probability_deal boolean, pipeline_risk boolean, "
    "insights array<struct<category: string, severity: string, account_ids: array<string>, "
    "description: string, recommended_action: string, estimated_revenue_impact: double>>, summary string"
)
INSIGHT_CATEGORIES = ("revenue_leak", "high_probability", "pipeline_risk")
INSIGHT_SEVERITIES = ("critical", "high", "medium", "low")


def reject_reason(raw: Column) -> Column:
    """Why a record is turned away before parsing; null when it passes every gate."""
    return (
        F.when(raw.isNull() | (F.trim(raw) == ""), "empty")
        .when(F.octet_length(raw) > MAX_BYTES, "too_large")
        .when(F.try_parse_json(raw).isNull(), "malformed")
        .when(F.json_object_keys(raw).isNull(), "not_an_object")
        .when(F.size(F.json_object_keys(raw)) > MAX_KEYS, "too_many_keys")
    )


def _clean_list(items: Column, longest: int) -> Column:
    cut = F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, longest)
    return F.transform(cut, lambda x: F.coalesce(sanitize_text(x, ITEM_CHARS), F.lit("None")))


def _score(raw: Column) -> Column:
    """Whole number 0..100: quoted text must be a whole number, a bare number is cut."""
    node = F.try_variant_get(F.try_parse_json(raw), "$.data_quality.score", "variant")
    text = F.try_variant_get(node, "$", "string")
    number = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(text.try_cast("double"), F.lit(0.0))))
    kind = F.schema_of_variant(node)
    return (
        F.when(kind == "STRING", score_clamp(text))
        .when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0))
        .otherwise(number.cast("int"))
    )


def _list_or_absent(raw: Column, key: str) -> Column:
    node = F.get_json_object(raw, f"$.{key}")
    return node.isNull() | F.json_array_length(node).isNotNull()


def parse_reports(df: DataFrame, raw: str = "raw", longest: int = MAX_LIST) -> DataFrame:
    """Validated, escaped and cut report fields; ``reject_reason`` tells why a row has none.

    Lists keep ``longest`` items; ``n_dropped`` says how many items of a row's lists were left out.
    """
    text = F.col(raw)
    gated = df.withColumn("_gate", reject_reason(text))
    parsed = gated.withColumn("_r", F.when(F.col("_gate").isNull(), F.from_json(text, REPORT_SCHEMA)))
    r = F.col("_r")
    metrics_ok = F.forall(
        F.coalesce(r["key_metrics"], F.array().cast("array<struct<label:string,value:string,delta:string,sentiment:string>>")),
        lambda m: m["label"].isNotNull() & m["value"].isNotNull()
        & F.coalesce(m["sentiment"].isin(*SENTIMENTS), F.lit(True)))
    insights_ok = F.forall(
        F.coalesce(r["insights"], F.array().cast("array<struct<title:string,detail:string,priority:string>>")),
        lambda i: i["title"].isNotNull() & i["detail"].isNotNull()
        & F.coalesce(i["priority"].isin(*PRIORITIES), F.lit(True)))
    reason = (
        F.when(F.col("_gate").isNotNull(), F.col("_gate"))
        .when(r["exec_summary"].isNull(), "summary_missing")
        .when(~_list_or_absent(text, "key_metrics") | ~F.coalesce(metrics_ok, F.lit(False)), "bad_metric")
        .when(~_list_or_absent(text, "insights") | ~F.coalesce(insights_ok, F.lit(False)), "bad_insight")
    )
    judged = parsed.withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()
    metrics = F.transform(F.coalesce(r["key_metrics"], F.array()), lambda m: F.struct(
        sanitize_text(m["label"], METRIC_CHARS).alias("label"),
        sanitize_text(m["value"], METRIC_CHARS).alias("value"),
        F.coalesce(sanitize_text(m["delta"], METRIC_CHARS), F.lit("")).alias("delta"),
        F.coalesce(m["sentiment"], F.lit("neutral")).alias("sentiment")))
    insights = F.transform(F.coalesce(r["insights"], F.array()), lambda i: F.struct(
        sanitize_text(i["title"], INSIGHT_CHARS).alias("title"),
        sanitize_text(i["detail"], INSIGHT_CHARS).alias("detail"),
        F.coalesce(i["priority"], F.lit("low")).alias("priority")))
    return judged.select(
        *[c for c in df.columns if c != raw],
        "reject_reason",
        F.when(ok, sanitize_text(r["exec_summary"], SUMMARY_CHARS)).alias("exec_summary"),
        F.when(ok, metrics).alias("key_metrics"),
        F.when(ok, insights).alias("insights"),
        F.when(ok, _score(text)).alias("quality_score"),
        F.when(ok, _clean_list(r["data_quality"]["issues"], longest)).alias("quality_issues"),
        F.when(ok, _clean_list(r["data_quality"]["recommendations"], longest)).alias("quality_recommendations"),
        F.when(ok, _clean_list(r["recommended_actions"], longest)).alias("recommended_actions"),
        F.when(ok, _clean_list(r["risk_flags"], longest)).alias("risk_flags"),
        F.when(ok, F.coalesce(r["security_alert"], F.lit(False))).alias("security_alert"),
        F.when(ok, sum((F.greatest(F.lit(0), F.coalesce(F.size(x), F.lit(0)) - longest) for x in (
            r["data_quality"]["issues"], r["data_quality"]["recommendations"], r["recommended_actions"], r["risk_flags"])),
            F.lit(0))).alias("n_dropped"),
    )


def render_reports(parsed: DataFrame, metrics_shown: int = 8) -> DataFrame:
    """Display and export text of accepted reports; ``metrics_hidden`` counts the metrics beyond those shown."""
    metric_lines = F.transform(F.slice("key_metrics", 1, metrics_shown), lambda m: F.concat(
        F.lit("- "), m["label"], F.lit(": "), m["value"], F.lit(" "), m["delta"], F.lit(" ["),
        code_map(m["sentiment"], SENTIMENT_CODES, "flat"), F.lit("]")))
    insight_lines = F.transform("insights", lambda i: F.concat(
        F.lit("- ["), F.upper(i["priority"]), F.lit("] "), i["title"], F.lit(": "), i["detail"]))
    numbered = F.transform("recommended_actions", lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a))
    risks = F.transform("risk_flags", lambda x: F.concat(F.lit("! "), x))
    keep = [c for c in parsed.columns if c not in (
        "reject_reason", "exec_summary", "key_metrics", "insights", "quality_score", "quality_issues",
        "quality_recommendations", "recommended_actions", "risk_flags", "security_alert", "n_dropped")]
    return parsed.where(F.col("reject_reason").isNull()).select(
        *keep, score_band(F.col("quality_score")).alias("quality_band"),
        F.greatest(F.lit(0), F.size("key_metrics") - metrics_shown).alias("metrics_hidden"),
        F.concat_ws(
            "\n", F.lit("SUMMARY"), F.col("exec_summary"), F.lit("METRICS"), metric_lines, F.lit("INSIGHTS"),
            insight_lines, F.lit("ACTIONS"), numbered, F.lit("RISKS"), risks,
            F.concat(F.lit("DATA QUALITY "), F.col("quality_score").cast("string"), F.lit("/100")))
        .alias("report_text"))


def within_budget(
    requests: DataFrame, session: list[str], order: list[str], limit: int = MAX_REPORTS_PER_SESSION
) -> DataFrame:
    """The first ``limit`` requests of every session; pruned map side before the shuffle."""
    place = Window.partitionBy(*session).orderBy(*order)
    return requests.withColumn("call_no", F.row_number().over(place)).where(F.col("call_no") <= limit)


def parse_insights(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per valid insight of a revenue report."""
    report = F.from_json(F.col(raw), INSIGHT_SCHEMA)
    rows = df.select(*[c for c in df.columns if c != raw], F.inline(report["insights"]))
    return rows.where(F.col("category").isin(*INSIGHT_CATEGORIES) & F.col("severity").isin(*INSIGHT_SEVERITIES))
