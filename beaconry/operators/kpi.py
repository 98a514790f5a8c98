"""KPI totals, history, anomaly checks and root-cause breakdowns.

KPI histories are long: one row per (metric_name, day). Their length is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z_LIMIT, BASELINE_DAYS, FLAG_PCT = 3.0, 30, 20.0


def core(df: DataFrame) -> DataFrame:
    """Revenue total, mean revenue per row and conversion as the ratio of sums."""
    return df.agg(
        F.sum("revenue").alias("revenue_total"), F.avg("revenue").alias("avg_order_value"),
        F.try_divide(F.sum("orders"), F.sum("visits")).alias("conversion_rate"))


def to_history(daily: DataFrame) -> DataFrame:
    rows = F.inline(F.array(
        F.struct(F.lit("revenue").alias("metric_name"), F.col("revenue").cast("double").alias("value")),
        F.struct(F.lit("orders").alias("metric_name"), F.col("orders").cast("double").alias("value")),
        F.struct(F.lit("conversion").alias("metric_name"),
                 F.try_divide(F.col("orders").cast("double"), F.col("visits")).alias("value"))))
    return daily.select("day", rows)


def with_baseline(history: DataFrame, days: int = BASELINE_DAYS, flag_pct: float = FLAG_PCT) -> DataFrame:
    """Mean of the ``days`` days before, change against it, and the flag of a large change."""
    number = F.date_diff("day", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("metric_name").orderBy(number).rangeBetween(-days, -1)
    based = history.withColumn("baseline", F.avg("value").over(w))
    change = F.try_divide(F.col("value") - F.col("baseline"), F.col("baseline")) * 100
    return based.withColumn("change_pct", change).withColumn(
        "anomaly_flag", F.coalesce(F.abs("change_pct") > flag_pct, F.lit(False)))


def z_scores(history: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    """Newest value of every metric against its whole history, newest value included."""
    stats = history.groupBy("metric_name").agg(
        F.max_by("value", "day").alias("latest"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    z = F.try_divide(F.col("latest") - F.col("mean"), F.col("std"))
    return stats.withColumn("z_score", z).withColumn("is_anomaly", F.coalesce(F.abs("z_score") > limit, F.lit(False)))


def repeated(flagged: DataFrame) -> DataFrame:
    """Anomalies whose metric was anomalous in the run before are unresolved."""
    before = F.lag("anomaly_flag").over(Window.partitionBy("metric_name").orderBy("day"))
    return flagged.withColumn("before", before).where("anomaly_flag").select(
        "metric_name", "day", F.when(F.col("before"), "unresolved").otherwise("new").alias("state"))


def seasonal(history: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    """z-score of every value against the earlier values of the same weekday."""
    w = Window.partitionBy("metric_name", F.dayofweek("day")).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    scored = history.select("*", F.avg("value").over(w).alias("mean"), F.stddev_samp("value").over(w).alias("std"))
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
    return scored.withColumn("z_score", z).select(
        "metric_name", "day", "value", "z_score", F.coalesce(F.abs("z_score") > limit, F.lit(False)).alias("is_anomaly"))


def root_cause(facts: DataFrame, dimensions: Sequence[str], amount: str, current: Column) -> DataFrame:
    """Change of ``amount`` between the earlier and the current window, over every mix of dimensions.

    Facts are summed to one row per dimension mix before the cube repeats them.
    """
    cells = facts.groupBy(*dimensions, current.alias("_now")).agg(F.sum(amount).alias("_s"))
    sums = cells.cube(*dimensions).agg(
        F.sum(F.when(F.col("_now"), F.col("_s")).otherwise(0.0)).alias("current_amount"),
        F.sum(F.when(F.col("_now"), 0.0).otherwise(F.col("_s"))).alias("earlier_amount"))
    return sums.select(
        *[F.coalesce(F.col(d).cast("string"), F.lit("ALL")).alias(d) for d in dimensions], "current_amount", "earlier_amount",
        (F.col("current_amount") - F.col("earlier_amount")).alias("delta"))


def findings(daily: DataFrame, causes: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    """Anomalous metrics with the breakdown rows that explain them; no rows where all is calm.

    There is at most one row per metric name, so the anomalous metrics are laid beside the breakdown as a broadcast frame.
    """
    hits = z_scores(to_history(daily), limit).where("is_anomaly").select("metric_name", "latest", "z_score")
    return causes.crossJoin(F.broadcast(hits))
