"""Classifier quality: confusion counts, macro scores, per-class scores and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.session import stored
from beaconry.settings import DEFAULTS


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def refusal(df: DataFrame, *names: str) -> str | None:
    """Why a table is not scored; null if it has all columns. A missing column is never made up from another."""
    try:
        require_columns(df, *names)
    except ValueError as e:
        return str(e)
    return None


def coverage(predictions: DataFrame, actuals: DataFrame, key: str) -> DataFrame:
    """How many keys have both sides, a prediction only, an actual value only."""
    sides = predictions.select(key, F.lit(1).alias("_p"), F.lit(0).alias("_a")).union(
        actuals.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("_p").alias("_p"), F.max("_a").alias("_a"))
    return sides.groupBy(F.when(F.col("_p") + F.col("_a") == 2, "both").when(F.col("_p") == 1, "prediction only").otherwise(
        "actual only").alias("side")).agg(F.count("*").alias("n"))


def align(predictions: DataFrame, actuals: DataFrame, key: str) -> DataFrame:
    """Join predictions to actuals by key; a key on one side only is an error. The join is made once."""
    joined = stored(predictions.withColumn("_p", F.lit(1)).join(actuals.withColumn("_a", F.lit(1)), key, "full_outer"), "aligned")
    lonely = joined.agg(F.count_if(F.col("_p").isNull() | F.col("_a").isNull()).alias("n")).first()["n"]
    if lonely:
        raise ValueError(f"{lonely} rows lack a prediction or an actual value")
    return joined.drop("_p", "_a")


def pair_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per (actual, prediction); everything else works on this small table."""
    require_columns(df, "actual", "prediction")
    return df.groupBy(*keys, "actual", "prediction").agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Counts over the full grid of the labels seen on either side."""
    counts = pair_counts(df)
    seen = counts.select(F.explode(F.array("actual", "prediction")).alias("label"))
    labels = seen.agg(F.sort_array(F.collect_set("label")).alias("labels"))  # one entry per class
    grid = labels.select("labels", F.explode("labels").alias("actual")).select(
        "actual", F.explode("labels").alias("prediction"))
    return grid.join(counts, ["actual", "prediction"], "left").select(
        "actual", "prediction", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def _per_class(counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    def side(label, tp, support, predicted):
        amounts = {"tp": tp, "support": support, "predicted": predicted}
        return F.struct(F.col(label).alias("label"), *[a.cast("bigint").alias(k) for k, a in amounts.items()])

    n, none = F.col("n"), F.lit(0)
    hit = F.when(F.col("actual") == F.col("prediction"), n).otherwise(none)
    sides = F.inline(F.array(side("actual", hit, n, none), side("prediction", none, none, n)))
    sums = counts.select(*keys, sides).groupBy(*keys, "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    zero = F.lit(0.0)
    return sums.select(
        *keys, "label", "tp", "support",
        F.coalesce(F.try_divide("tp", "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), zero).alias("f1"))


def class_report(df: DataFrame) -> DataFrame:
    return _per_class(pair_counts(df), ()).select(
        "label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


def scorecard(df: DataFrame, *keys: str) -> DataFrame:
    """Accuracy and macro precision, recall and F1; a division by zero counts as 0."""
    return scorecard_from_counts(pair_counts(df, *keys), *keys)


def scorecard_from_counts(counts: DataFrame, *keys: str) -> DataFrame:
    """Scorecard of confusion counts (keys, actual, prediction, n)."""
    return _per_class(counts, keys).groupBy(*keys).agg(
        F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"),
        F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("recall"), 4).alias("recall"),
        F.round(F.avg("f1"), 4).alias("f1"), F.sum("support").alias("total_predictions"))


def accuracy_alerts(cards: DataFrame, threshold: float = DEFAULTS.accuracy_threshold) -> DataFrame:
    """Alert rows for scorecards whose rounded accuracy is too low."""
    return cards.where(F.col("accuracy") < threshold).select(
        *[c for c in cards.columns if c not in ("accuracy", "precision", "recall", "f1", "total_predictions")],
        F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"), F.lit(threshold).alias("threshold"),
        F.lit("warning").alias("severity"),
        F.format_string("accuracy %.4f is under the limit %.4f", "accuracy", F.lit(threshold)).alias("message"))
