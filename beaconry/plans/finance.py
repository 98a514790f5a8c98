"""Finance queries over the monthly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.operators import finance as X
from beaconry.plans.oracle_views import add_view
from beaconry.plans.registry import query
from beaconry.sources import bindings as B

add_view("fin_long", """
    SELECT 'revenue' AS series, period AS t, revenue AS y, row_number() OVER (ORDER BY period) - 1 AS idx FROM monthly_finance
    UNION ALL SELECT 'expenses', period, expenses, row_number() OVER (ORDER BY period) - 1 FROM monthly_finance
    UNION ALL SELECT 'payroll', period, payroll, row_number() OVER (ORDER BY period) - 1 FROM monthly_finance""")
add_view("smooth", """
    SELECT series, t, idx, y, y AS s FROM fin_long WHERE idx = 0
    UNION ALL SELECT l.series, l.t, l.idx, l.y, 0.3 * l.y + 0.7 * p.s FROM smooth p
    JOIN fin_long l ON l.series = p.series AND l.idx = p.idx + 1""")
add_view("fits", """
    SELECT series, arg_max(s, idx) AS last, regr_slope(s, idx) AS slope, AVG(y) AS average, regr_slope(y, idx) AS trend
    FROM smooth GROUP BY series""")
add_view("base_row", """
    SELECT MAX(CASE WHEN series = 'revenue' THEN last + slope END) AS r, MAX(CASE WHEN series = 'expenses' THEN last + slope END) AS e,
           MAX(CASE WHEN series = 'payroll' THEN last + slope END) AS p FROM fits""")
add_view("fin_outliers", """
    WITH s AS (SELECT series, AVG(y) AS m, stddev_pop(y) AS sd FROM fin_long GROUP BY 1)
    SELECT l.*, m, sd, abs((y - m) / sd) AS z FROM fin_long l JOIN s USING (series) WHERE sd > 0 AND abs((y - m) / sd) > 2""")
add_view("fin_turns", """
    WITH d AS (SELECT *, y - lag(y) OVER w AS pc, lead(y) OVER w - y AS nc FROM fin_long
               WINDOW w AS (PARTITION BY series ORDER BY idx))
    SELECT *, abs((nc - pc) / pc) AS ratio, CASE WHEN pc > 0 AND nc < 0 THEN 'reversal_down' WHEN pc < 0 AND nc > 0
           THEN 'reversal_up' ELSE 'acceleration' END AS type
    FROM d WHERE pc <> 0 AND nc IS NOT NULL AND (abs((nc - pc) / pc) > 0.2 OR (pc > 0 AND nc < 0) OR (pc < 0 AND nc > 0))""")
add_view("fin_flags", """
    SELECT period AS t, 'negative_cash_flow' AS type, revenue - expenses - payroll AS amount, 'high' AS severity
    FROM stressed WHERE revenue - expenses - payroll < 0
    UNION ALL SELECT period, 'high_expense_ratio', expenses / revenue, 'medium' FROM stressed WHERE expenses / revenue > 0.8
    UNION ALL SELECT period, 'high_payroll_ratio', payroll / revenue, 'medium' FROM stressed WHERE payroll / revenue > 0.5""")


# Costs raised in some months, so that every flag has cases.
add_view("stressed", """
    SELECT period, revenue, expenses * (1 + (period % 4) * 0.15) AS expenses, payroll * (1 + (period % 3) * 2) AS payroll
    FROM monthly_finance""")


def _stressed(t):
    p = F.col("period")
    return B.monthly_finance(t).select(
        "period", "revenue", (F.col("expenses") * (1 + (p % 4) * F.lit(0.15))).alias("expenses"),
        (F.col("payroll") * (1 + (p % 3) * 2)).alias("payroll"))


def _long(t):
    return X.to_long(B.monthly_finance(t), "period")


def _round(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("net_cash_flow", """
    SELECT period, round(revenue - expenses - payroll, 4) AS net_cash_flow, 'monthly' AS period_kind FROM monthly_finance""")
def _net(t):
    return _round(X.net_cash_flow(B.monthly_finance(t)), 4, "net_cash_flow").select("period", "net_cash_flow", "period_kind")


@query("exp_smooth", "SELECT series, t, round(s, 1) AS smoothed FROM smooth")
def _smooth(t):
    return _round(X.exponential_smoothing(_long(t)), 1, "smoothed").select("series", "t", "smoothed")


@query("trend_slope", "SELECT series, round(trend, 4) AS slope FROM fits")
def _slope(t):
    return _round(X.trend_slope(_long(t)), 4, "slope")


@query("forecast", """
    SELECT series, CAST(h AS INT) AS step, round(last + slope * h, 4) AS forecast FROM fits, generate_series(1, 3) g(h)""")
def _forecast(t):
    return _round(X.forecast(_long(t)), 4, "forecast")


@query("fin_metrics", """
    SELECT series, round(average, 4) AS average, round(trend, 4) AS trend, round(last + slope, 4) AS next_period FROM fits""")
def _metrics(t):
    return _round(X.metrics(_long(t)), 4, "average", "trend", "next_period")


@query("scenarios", """
    WITH c AS (SELECT s AS scenario, r * fr AS revenue, e * fe AS expenses, p AS payroll FROM base_row,
                      (VALUES ('best', 1.15, 0.95), ('likely', 1.0, 1.0), ('worst', 0.9, 1.1)) v(s, fr, fe)),
         n AS (SELECT *, revenue - expenses - payroll AS net FROM c)
    SELECT scenario, round(revenue, 4) AS revenue, round(expenses, 4) AS expenses, round(payroll, 4) AS payroll,
           round(net, 4) AS net_income, round((SELECT MAX(net) - MIN(net) FROM n), 4) AS net_spread,
           round((SELECT MAX(revenue) - MIN(revenue) FROM n), 4) AS revenue_spread,
           round((SELECT MAX(expenses) - MIN(expenses) FROM n), 4) AS expense_spread FROM n""")
def _scenarios(t):
    out = X.scenarios(X.projected_net(X.metrics(_long(t))))
    return _round(out, 4, *[c for c in out.columns if c != "scenario"])


@query("outliers_2sd", """
    SELECT series, t, round(y, 2) AS value, round(z, 6) AS z_score, round(y - m, 2) AS deviation FROM fin_outliers""")
def _outliers(t):
    return _round(X.outliers(_long(t)), 2, "value", "deviation").select(
        "series", "t", "value", F.round("z_score", 6).alias("z_score"), "deviation")


@query("trend_changes", """
    SELECT series, t, round(pc, 4) AS previous_change, round(nc, 4) AS next_change, round(ratio, 4) AS change_ratio, type FROM fin_turns""")
def _turns(t):
    return _round(X.trend_changes(_long(t)), 4, "previous_change", "next_change").select(
        "series", "t", "previous_change", "next_change", F.round("change_ratio", 4).alias("change_ratio"), "type")


@query("cashflow_flags", "SELECT t, type, round(amount, 6) AS amount, severity FROM fin_flags")
def _flags(t):
    return _round(X.cash_flow_flags(_stressed(t), "period"), 6, "amount")


@query("anomaly_summary", """
    WITH c AS (SELECT (SELECT COUNT(*) FROM fin_outliers) AS outliers, (SELECT COUNT(*) FROM fin_turns) AS trend_changes,
                      (SELECT COUNT(*) FROM fin_flags) AS cash_flow)
    SELECT *, outliers + trend_changes + cash_flow > 0 AS has_anomalies FROM c""")
def _summary(t):
    return X.anomaly_summary(_long(t), _stressed(t), "period")


@query("exec_report")
def _exec(t):
    return X.executive_report(B.monthly_finance(t), "period", "2024-01-31")
