"""Stream forms of metering, scorecards, drift and KPIs on built-in state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.streaming.runner import utc_day, utc_instant

LATENESS = "1 hour"


def daily_usage(requests: DataFrame) -> DataFrame:
    """Calls per tenant and day (request_id, ts, tenant_id); ``update`` for totals, ``append`` for closed days."""
    seen = requests.withColumn("seen_at", utc_instant(F.col("ts"))).withWatermark("seen_at", LATENESS)
    counts = seen.groupBy(F.window("seen_at", "1 day").alias("w"), "tenant_id").agg(F.count("*").alias("calls"))
    return counts.select(utc_day(F.col("w.start")).alias("day"), "tenant_id", "calls")


def daily_confusion(scored: DataFrame) -> DataFrame:
    """Rows per (day, actual, prediction); scorecards are computed from these few counts."""
    seen = scored.withColumn("seen_at", utc_instant(F.col("ts"))).withWatermark("seen_at", LATENESS)
    counts = seen.groupBy(F.window("seen_at", "1 day").alias("w"), "actual", "prediction").agg(F.count("*").alias("n"))
    return counts.select(utc_day(F.col("w.start")).alias("day"), "actual", "prediction", "n")


def _kpi_sums(events: DataFrame, window: Column) -> DataFrame:
    bought, viewed = F.col("event_type") == "purchase", F.col("event_type") == "view"
    return events.groupBy(window).agg(
        F.sum(F.when(bought, F.col("value")).otherwise(0.0)).alias("revenue"),
        F.count_if(bought).alias("orders"), F.count_if(viewed).alias("visits"))


def daily_kpis(events: DataFrame) -> DataFrame:
    """Revenue, orders and visits per day, updated as events come in."""
    seen = events.withColumn("seen_at", utc_instant(F.col("ts"))).withWatermark("seen_at", LATENESS)
    return _kpi_sums(seen, F.window("seen_at", "1 day").alias("w")).select(
        utc_day(F.col("w.start")).alias("day"), "revenue", "orders", "visits")


def sliding_kpis(events: DataFrame, length: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Revenue, orders and visits per sliding window; ``append`` gives each window once, when the watermark closes it."""
    seen = events.withColumn("seen_at", utc_instant(F.col("ts"))).withWatermark("seen_at", LATENESS)
    return _kpi_sums(seen, F.window("seen_at", length, slide).alias("w")).select(
        utc_day(F.col("w.end")).alias("day"), "revenue", "orders", "visits")


def value_counts(events: DataFrame, value: str = "value") -> DataFrame:
    """How often each value occurs per day: counts merge, and the state of a day goes when the watermark closes it."""
    seen = events.withColumn("seen_at", utc_instant(F.col("ts"))).withWatermark("seen_at", LATENESS)
    counts = seen.groupBy(F.window("seen_at", "1 day").alias("w"), value).agg(F.count("*").alias("n"))
    return counts.select(utc_day(F.col("w.start")).alias("day"), value, "n")


def repetitions(
    requests: DataFrame, request: Sequence[str], length: str = "1 minute", slide: str = "10 seconds", limit: int = 10
) -> DataFrame:
    """Tenants that send the same request at least ``limit`` times within a sliding window (ts, tenant_id, request columns).

    Works on a stream (closed windows, ``append``) and on a table. Requests are counted before the shuffle, so one that is
    repeated without end is still one row per task and window.
    """
    instant = requests.withColumn("seen_at", utc_instant(F.col("ts")))
    seen = instant.withWatermark("seen_at", LATENESS) if requests.isStreaming else instant
    body = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in request]), 256)
    counts = seen.groupBy(F.window("seen_at", length, slide).alias("w"), "tenant_id", body.alias("request")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= limit).select(
        "tenant_id", "request", F.unix_seconds("w.start").alias("from_second"), F.unix_seconds("w.end").alias("to_second"), "n")


def once(events: DataFrame, key: str) -> DataFrame:
    """Each event once, however often the feed sends it; what comes after the watermark is dropped and counted (see ``run``)."""
    seen = events.withColumn("seen_at", utc_instant(F.col("ts"))).withWatermark("seen_at", LATENESS)
    return seen.dropDuplicates([key, "seen_at"])
