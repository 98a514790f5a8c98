"""Metric history, health report and retraining decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.functions.scalars import fmt_pct, spark_bar
from beaconry.functions.sequences import last_known
from beaconry.operators.chains import triggers
from beaconry.session import stored
from beaconry.settings import DEFAULTS


def last_n(history: DataFrame, ts: str, n: int) -> DataFrame:
    """The newest ``n`` records in time order."""
    return history.orderBy(F.desc(ts)).limit(n).orderBy(ts)


def latest(history: DataFrame, ts: str) -> DataFrame:
    row = F.struct(*history.columns)
    return history.agg(F.max_by(row, F.col(ts)).alias("r")).where("r is not null").select("r.*")


def health_report(
    history: DataFrame, ts: str, n: int, threshold: float = DEFAULTS.accuracy_threshold
) -> DataFrame:
    """Trend lines of the last ``n`` records with the status of each."""
    return last_n(history, ts, n).select(
        ts, F.when(F.round("accuracy", 4) < threshold, "FAIL").otherwise("PASS").alias("status"),
        fmt_pct(F.col("accuracy")).alias("accuracy_text"), spark_bar(F.col("accuracy")).alias("bar"),
        "total_predictions")


def report_text(trend: DataFrame, ts: str) -> DataFrame:
    """One text: status of the newest record and the trend, at most ``n`` lines long."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(
        F.col(ts).cast("string").alias("t"), "bar", "accuracy_text", "status"))),
        lambda r: F.concat_ws("  ", r["t"], r["bar"], r["accuracy_text"]))
    return trend.agg(F.concat_ws(
        "\n", F.concat(F.lit("MODEL HEALTH: "), F.max_by("status", ts)), F.lit("ACCURACY TREND"), lines)
        .alias("report"))


def accuracy_trend(history: DataFrame, ts: str) -> DataFrame:
    return history.select(F.date_trunc("second", ts).alias("seen_at"), "accuracy").dropna()


def retrain_decisions(
    cycles: DataFrame, cooldown: int = DEFAULTS.retrain_cooldown_seconds,
    min_features: int = 1, max_accuracy: float | None = None,
) -> DataFrame:
    """Decision per cycle (model_id, at, any_drift[, features_drifted, accuracy, failed]); ``at`` is in whole seconds.

    A trigger is the first wanted cycle at least the cool-down after the trigger before (see ``chains``); a failed retraining does
    not start the cool-down, so failed cycles are no part of the chain: they only tell an error where one was due.
    """
    cycles = stored(cycles, "cycles")
    wanted = F.col("any_drift")
    if "features_drifted" in cycles.columns:
        wanted = wanted & (F.col("features_drifted") >= min_features)
    if max_accuracy is not None:
        wanted = wanted | (F.col("accuracy") < max_accuracy)
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in cycles.columns else F.lit(False)
    fired = stored(triggers(cycles.where(wanted & ~failed), "model_id", "at", cooldown), "fired")
    moves = fired.select("model_id", "at", F.lit("retraining_triggered").alias("move"))
    if "failed" in cycles.columns:
        tries = cycles.where(wanted & failed).select("model_id", "at", F.lit(None).cast("bigint").alias("fired_at"))
        every = fired.select("model_id", "at", F.col("at").alias("fired_at")).unionByName(tries).groupBy("model_id", "at").agg(
            F.max("fired_at").alias("fired_at"))  # one row for each model and second
        day = F.floor(F.col("at") / 86400)
        since = last_known(every, ["model_id"], "at", day, "fired_at", "last_fired", inclusive=True)
        due = F.col("last_fired").isNull() | (F.col("at") - F.col("last_fired") >= cooldown)
        moves = moves.unionByName(since.where(due).select("model_id", "at", F.lit("error:retraining failed").alias("move")))
    return cycles.join(moves, ["model_id", "at"], "left").select(
        *cycles.columns,
        F.when(~F.coalesce(wanted, F.lit(False)), "model_stable").otherwise(F.coalesce("move", F.lit("cool_down_active")))
        .alias("decision"))
