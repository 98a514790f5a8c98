"""Smoothing, forecasts, scenarios and anomalies over periodic series.

Inputs are long: one row per (series, t, y), where ``t`` is a calendar period. A series has one
row per period, so its length is bounded by the calendar and not by the size of the tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions.scalars import ratio_or_infinite

# Smoothing factor, horizon, scenario factors and anomaly limits.
ALPHA, HORIZON = 0.3, 3
SCENARIOS = (("best", 1.15, 0.95), ("likely", 1.0, 1.0), ("worst", 0.90, 1.10))
OUTLIER_SD, TREND_RATIO, EXPENSE_RATIO, PAYROLL_RATIO = 2.0, 0.2, 0.8, 0.5
MEASURES = ("revenue", "expenses", "payroll")


def to_long(wide: DataFrame, t: str, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Long form with a running index per series; null or NaN counts as 0."""
    pairs = F.inline(F.array(*[
        F.struct(F.lit(m).alias("series"), F.coalesce(F.nanvl(F.col(m).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("y"))
        for m in measures]))
    long = wide.select(F.col(t).alias("t"), pairs)
    place = Window.partitionBy("series").orderBy("t")
    return long.withColumn("idx", F.row_number().over(place) - 1)


def net_cash_flow(wide: DataFrame, period: str = "monthly") -> DataFrame:
    net = F.col("revenue") - F.col("expenses") - F.col("payroll")
    return wide.select("*", net.alias("net_cash_flow"), F.lit(period).alias("period_kind"))


def exponential_smoothing(long: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Adds ``smoothed``: s0 = y0, then alpha*y + (1-alpha)*s.

    A series is cut into blocks so long that what came two blocks before weighs less than one
    part in 10^18. Inside a block a weighted running sum does the work, and one value per block
    is handed to the next.
    """
    keep = 1.0 - alpha
    size = max(1, math.ceil(18 * math.log(10) / -math.log(keep))) if 0 < keep < 1 else 1
    if keep <= 0:
        return long.withColumn("smoothed", F.col("y"))
    if keep >= 1:
        first = Window.partitionBy("series").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
        return long.withColumn("smoothed", F.first("y").over(first))
    tagged = long.withColumns({
        "_b": F.floor(F.col("idx") / size), "_k": F.col("idx") % size,
        "_w": F.when(F.col("idx") == 0, 1.0).otherwise(alpha)})
    upto = Window.partitionBy("series", "_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(F.col("_w") * F.col("y") * F.pow(F.lit(keep), -F.col("_k"))).over(upto) * F.pow(F.lit(keep), F.col("_k"))
    local = tagged.withColumn("_own", own)
    ends = local.groupBy("series", (F.col("_b") + 1).alias("_b")).agg(F.max_by("_own", "idx").alias("_carry"))
    return local.join(ends, ["series", "_b"], "left").select(
        *long.columns,
        (F.col("_own") + F.coalesce("_carry", F.lit(0.0)) * F.pow(F.lit(keep), F.col("_k") + 1)).alias("smoothed"))


def trend_slope(long: DataFrame, y: str = "y") -> DataFrame:
    """Least-squares slope against the index; below two points 0."""
    return long.groupBy("series").agg(F.coalesce(F.regr_slope(F.col(y), F.col("idx")), F.lit(0.0)).alias("slope"))


def forecast(long: DataFrame, periods: int = HORIZON, alpha: float = ALPHA) -> DataFrame:
    """Last smoothed value plus the slope of the smoothed series times the distance."""
    smooth = exponential_smoothing(long, alpha)
    fit = smooth.groupBy("series").agg(
        F.max_by("smoothed", "idx").alias("last"),
        F.coalesce(F.regr_slope("smoothed", "idx"), F.lit(0.0)).alias("slope"))
    return fit.select("series", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"), "last", "slope").select(
        "series", "step", (F.col("last") + F.col("slope") * F.col("step")).alias("forecast"))


def metrics(long: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Mean, slope of the raw series and the next period, per series."""
    raw = long.groupBy("series").agg(
        F.avg("y").alias("average"), F.coalesce(F.regr_slope("y", "idx"), F.lit(0.0)).alias("trend"))
    nxt = forecast(long, 1, alpha).select("series", F.col("forecast").alias("next_period"))
    return raw.join(nxt, "series")


def projected_net(series_metrics: DataFrame) -> DataFrame:
    """One row: next revenue, expenses and payroll and what is left of them."""
    wide = series_metrics.agg(*[
        F.coalesce(F.max(F.when(F.col("series") == m, F.col("next_period"))), F.lit(0.0)).alias(m) for m in MEASURES])
    return wide.withColumn("projected_net_income", F.col("revenue") - F.col("expenses") - F.col("payroll"))


def scenarios(base: DataFrame) -> DataFrame:
    """Best, likely and worst case of a base row, with the spreads between best and worst."""
    cases = F.inline(F.array(*[
        F.struct(F.lit(n).alias("scenario"), (F.col("revenue") * r).alias("case_revenue"),
                 (F.col("expenses") * e).alias("case_expenses"), F.col("payroll").alias("case_payroll"))
        for n, r, e in SCENARIOS]))
    rev, exp = F.col("revenue"), F.col("expenses")
    net = [rev * r - exp * e - F.col("payroll") for _, r, e in SCENARIOS]
    spread = base.select(
        "*", (net[0] - net[2]).alias("net_spread"), (rev * SCENARIOS[0][1] - rev * SCENARIOS[2][1]).alias("revenue_spread"),
        (exp * SCENARIOS[2][2] - exp * SCENARIOS[0][2]).alias("expense_spread"))
    return spread.select(cases, "net_spread", "revenue_spread", "expense_spread").select(
        "scenario", F.col("case_revenue").alias("revenue"), F.col("case_expenses").alias("expenses"),
        F.col("case_payroll").alias("payroll"),
        (F.col("case_revenue") - F.col("case_expenses") - F.col("case_payroll")).alias("net_income"),
        "net_spread", "revenue_spread", "expense_spread")


def outliers(long: DataFrame, limit: float = OUTLIER_SD) -> DataFrame:
    """Points further than ``limit`` population deviations from the mean of their series."""
    stats = long.groupBy("series").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std_dev"))
    scored = long.join(stats, "series").withColumn(
        "z_score", F.abs(F.try_divide(F.col("y") - F.col("mean"), F.col("std_dev"))))
    return scored.where(F.col("z_score") > limit).select(
        "series", "t", "idx", F.col("y").alias("value"), "mean", "std_dev", "z_score",
        (F.col("y") - F.col("mean")).alias("deviation"))


def trend_changes(long: DataFrame, limit: float = TREND_RATIO) -> DataFrame:
    """Interior points where the step turns around or changes by more than ``limit``."""
    w = Window.partitionBy("series").orderBy("idx")
    steps = long.select(
        "*", (F.col("y") - F.lag("y").over(w)).alias("previous_change"), (F.lead("y").over(w) - F.col("y")).alias("next_change"))
    prev, nxt = F.col("previous_change"), F.col("next_change")
    down, up = (prev > 0) & (nxt < 0), (prev < 0) & (nxt > 0)
    ratio = F.abs(F.try_divide(nxt - prev, prev))
    return steps.where(prev.isNotNull() & nxt.isNotNull() & (prev != 0)).withColumn("change_ratio", ratio).where(
        (F.col("change_ratio") > limit) | down | up).select(
        "series", "t", "idx", F.col("y").alias("value"), "previous_change", "next_change", "change_ratio",
        F.when(down, "reversal_down").when(up, "reversal_up").otherwise("acceleration").alias("type"))


def cash_flow_flags(wide: DataFrame, t: str) -> DataFrame:
    """One row per flag: negative cash flow, high expense share, high payroll share."""
    rev, exp, pay = F.col("revenue"), F.col("expenses"), F.col("payroll")
    net = rev - exp - pay
    by_exp, by_pay = ratio_or_infinite(exp, rev), ratio_or_infinite(pay, rev)

    def flag(on, kind, amount, severity):
        return F.when(on, F.struct(F.lit(kind).alias("type"), amount.alias("amount"), F.lit(severity).alias("severity")))

    flags = F.array_compact(F.array(
        flag(net < 0, "negative_cash_flow", net, "high"),
        flag(by_exp > EXPENSE_RATIO, "high_expense_ratio", by_exp, "medium"),
        flag(by_pay > PAYROLL_RATIO, "high_payroll_ratio", by_pay, "medium")))
    return wide.select(F.col(t).alias("t"), F.inline(flags))


def anomaly_summary(long: DataFrame, wide: DataFrame, t: str) -> DataFrame:
    kinds = (
        outliers(long).select(F.lit("outliers").alias("kind"))
        .unionByName(trend_changes(long).select(F.lit("trend_changes").alias("kind")))
        .unionByName(cash_flow_flags(wide, t).select(F.lit("cash_flow").alias("kind"))))
    return kinds.agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("outliers", "trend_changes", "cash_flow")],
        (F.count("*") > 0).alias("has_anomalies"))


def executive_report(wide: DataFrame, t: str, as_of: str) -> DataFrame:
    """One JSON document: forecast, scenarios, anomaly counts and advice."""
    long = to_long(wide, t)
    base = projected_net(metrics(long))
    cases = scenarios(base).agg(F.sort_array(F.collect_list(F.struct("scenario", "net_income"))).alias("scenarios"))
    parts = base.select(F.struct(*base.columns).alias("forecast")).withColumn("_one", F.lit(1))
    for part in (cases, anomaly_summary(long, wide, t).select(F.struct("*").alias("anomalies"))):  # one row each
        parts = parts.join(part.withColumn("_one", F.lit(1)), "_one")
    return parts.select(F.to_json(F.struct(
        F.lit("Finance forecast").alias("title"), F.lit(as_of).alias("date"), "forecast", "scenarios", "anomalies",
        F.lit("check the flagged anomalies and the effect of each scenario").alias("advice"))).alias("report"))
