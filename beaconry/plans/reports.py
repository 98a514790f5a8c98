"""Report-record gates, validation and enum helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions import scalars as S
from beaconry.operators import reports as R
from beaconry.plans.profiling import _escape_sql
from beaconry.plans.registry import query

_MANY = "{" + ",".join(f'"k{i}":{i}' for i in range(25)) + "}"
_RAW_SQL = f"""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN substr(props, 1, length(props) - 1) WHEN 1 THEN ''
           WHEN 2 THEN '[' || props || ']' WHEN 3 THEN '{_MANY}' ELSE props END AS raw FROM events"""


def _raw(t):
    k, p = F.col("event_id") % 6, F.col("props")
    return t.events.select("event_id", F.when(k == 0, F.expr("substr(props, 1, length(props) - 1)"))
                           .when(k == 1, "").when(k == 2, F.concat(F.lit("["), p, F.lit("]")))
                           .when(k == 3, F.lit(_MANY)).otherwise(p).alias("raw"))


@query("gate_size", "SELECT doc_id, strlen(text) <= 65536 AS passes FROM documents")
def _gate_size(t):
    return t.documents.select("doc_id", (F.octet_length("text") <= R.MAX_BYTES).alias("passes"))


@query("gate_json", f"""
    WITH r AS ({_RAW_SQL})
    SELECT CASE WHEN trim(raw) = '' THEN 'empty' WHEN NOT json_valid(raw) THEN 'malformed'
                WHEN json_type(raw) <> 'OBJECT' THEN 'not_an_object' WHEN len(json_keys(raw)) > 20 THEN 'too_many_keys'
                ELSE 'accepted' END AS outcome, COUNT(*) AS n
    FROM r GROUP BY 1""")
def _gate_json(t):
    return _raw(t).groupBy(F.coalesce(R.reject_reason(F.col("raw")), F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("n"))


@query("gate_keys", f"""
    WITH r AS ({_RAW_SQL}),
         v AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw END AS raw FROM r)
    SELECT event_id, coalesce(json_type(raw) = 'OBJECT' AND len(json_keys(raw)) <= 20, FALSE) AS passes FROM v""")
def _gate_keys(t):
    return _raw(t).select("event_id", F.coalesce(F.size(F.json_object_keys("raw")) <= R.MAX_KEYS, F.lit(False))
                          .alias("passes"))


# Report records made from every document: the text is the summary, bad enums and missing summaries occur.
def _report_json(t):
    k = F.col("doc_id")
    metric = F.struct(F.col("lang").alias("label"), F.col("n_chars").alias("value"),
                      F.when(k % 9 == 4, "ecstatic").when(k % 2 == 0, "positive").alias("sentiment"))
    insight = F.struct(F.col("source").alias("title"), F.col("text").alias("detail"),
                       F.when(k % 11 == 5, "urgent").when(k % 3 == 0, "high").alias("priority"))
    return t.documents.select("doc_id", F.to_json(F.struct(
        F.when(k % 13 != 7, F.col("text")).alias("exec_summary"), F.array(metric).alias("key_metrics"),
        F.array(insight).alias("insights"),
        F.struct((k % 150 - 20).alias("score"), F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.concat(
            F.lit("<"), i.cast("string"), F.lit(">"))).alias("issues")).alias("data_quality"),
        F.lit("dropped").alias("extra_key"))).alias("raw"))


@query("parse_report", f"""
    WITH base AS (
      SELECT doc_id, CASE WHEN strlen(to_json(text)) * (CASE WHEN doc_id % 13 = 7 THEN 1 ELSE 2 END)
                               + strlen(lang) + strlen(source) + 500 > 65536 THEN 'too_large'
             WHEN doc_id % 13 = 7 THEN 'summary_missing' WHEN doc_id % 9 = 4 THEN 'bad_metric'
             WHEN doc_id % 11 = 5 THEN 'bad_insight' END AS reject_reason, text, lang, n_chars, source FROM documents)
    SELECT doc_id, reject_reason,
           CASE WHEN reject_reason IS NULL THEN {_escape_sql('text', 1500)} END AS exec_summary,
           CASE WHEN reject_reason IS NULL THEN {_escape_sql('lang', 200)} || '=' || n_chars || ' '
                || CASE WHEN doc_id % 2 = 0 THEN 'positive' ELSE 'neutral' END END AS metric,
           CASE WHEN reject_reason IS NULL THEN {_escape_sql('source', 500)} || '/' || {_escape_sql('text', 500)} || '/'
                || CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END END AS insight,
           CASE WHEN reject_reason IS NULL THEN CAST(greatest(0, least(100, doc_id % 150 - 20)) AS INT) END AS score,
           CASE WHEN reject_reason IS NULL THEN 20 END AS n_issues,
           CASE WHEN reject_reason IS NULL THEN '&lt;20&gt;' END AS last_issue
    FROM base""")
def _parse_report(t):
    p = R.parse_reports(_report_json(t))
    m, i = F.col("key_metrics")[0], F.col("insights")[0]
    return p.select(
        "doc_id", "reject_reason", "exec_summary",
        F.concat(m["label"], F.lit("="), m["value"], F.lit(" "), m["sentiment"]).alias("metric"),
        F.concat(i["title"], F.lit("/"), i["detail"], F.lit("/"), i["priority"]).alias("insight"),
        F.col("quality_score").alias("score"), F.size("quality_issues").alias("n_issues"),
        F.element_at("quality_issues", -1).alias("last_issue"))


@query("report_render")
def _report_render(t):
    return R.render_reports(R.parse_reports(_report_json(t)))


@query("call_budget", """
    SELECT event_id, user_id, CAST(ts AS DATE) AS session_day,
           CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INT) AS call_no
    FROM events QUALIFY call_no <= 5""")
def _call_budget(t):
    calls = t.events.select("event_id", "user_id", F.to_date("ts").alias("session_day"), "ts")
    return R.within_budget(calls, ["user_id", "session_day"], ["ts", "event_id"]).drop("ts")


@query("insight_schema", """
    SELECT event_id, 'revenue_leak' AS category,
           CASE WHEN value > 100 THEN 'critical' WHEN value > 50 THEN 'high' ELSE 'low' END AS severity,
           'user-' || user_id AS account, round(value, 2) AS impact
    FROM events WHERE event_type <> 'error'""")
def _insight_schema(t):
    v = F.col("value")
    one = F.struct(
        F.when(F.col("event_type") == "error", "unheard_of").otherwise("revenue_leak").alias("category"),
        F.when(v > 100, "critical").when(v > 50, "high").otherwise("low").alias("severity"),
        F.array(F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("account_ids"),
        v.alias("estimated_revenue_impact"))
    raw = t.events.select("event_id", F.to_json(F.struct(F.array(one).alias("insights"))).alias("raw"))
    return R.parse_insights(raw).select(
        "event_id", "category", "severity", F.col("account_ids")[0].alias("account"),
        F.round("estimated_revenue_impact", 2).alias("impact"))


@query("severity_score", """
    SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 100 WHEN '2' THEN 75 ELSE 50 END AS score
    FROM orders""")
def _severity(t):
    p = F.substring("o_orderpriority", 1, 1)
    sev = F.when(p == "1", "critical").when(p == "2", "high").when(p == "3", "medium").otherwise("low")
    return t.orders.select("o_orderkey", S.severity_score(sev).alias("score"))


@query("score_clamp", r"""
    WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 300 - 100 AS VARCHAR)
                      WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN 'A+' ELSE ' 85 ' END AS s FROM events)
    SELECT event_id, CASE WHEN regexp_full_match(trim(s), '[+-]?\d{1,18}')
                          THEN CAST(greatest(0, least(100, CAST(trim(s) AS BIGINT))) AS INT) ELSE 0 END AS score FROM x""")
def _score_clamp(t):
    k = F.col("event_id")
    s = (F.when(k % 4 == 0, (k % 300 - 100).cast("string")).when(k % 4 == 1, F.col("value").cast("string"))
         .when(k % 4 == 2, "A+").otherwise(" 85 "))
    return t.events.select("event_id", S.score_clamp(s).alias("score"))


@query("score_band", """
    SELECT CASE WHEN l_quantity * 2 >= 80 THEN 'good' WHEN l_quantity * 2 >= 60 THEN 'warn' ELSE 'bad' END AS band,
           COUNT(*) AS n FROM lineitem GROUP BY 1""")
def _score_band(t):
    return t.lineitem.groupBy(S.score_band(F.col("l_quantity") * 2).alias("band")).agg(F.count("*").alias("n"))


@query("sentiment_priority_map", """
    SELECT event_id, CASE event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' ELSE 'flat' END AS sentiment_code,
           CASE event_type WHEN 'error' THEN 'red' WHEN 'click' THEN 'amber' ELSE 'green' END AS priority_code FROM events""")
def _sentiment(t):
    e = F.col("event_type")
    sentiment = F.when(e == "purchase", "positive").when(e == "error", "negative").otherwise(e)
    priority = F.when(e == "error", "high").when(e == "click", "medium").otherwise(F.lit(None))
    return t.events.select(
        "event_id", S.code_map(sentiment, R.SENTIMENT_CODES, "flat").alias("sentiment_code"),
        S.code_map(priority, R.PRIORITY_CODES, "green").alias("priority_code"))
