"""Writers: metric log, index, plans, alerts and models. Paths are shared folders or tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_metrics(records: DataFrame, path: str, period: str | None = None) -> None:
    """Append records to the JSON-lines metric log; they go to its current period, a folder of its own."""
    period = period or current_period(records.sparkSession, path)
    records.withColumn("archive_id", F.lit(period)).write.mode("append").partitionBy("archive_id").json(path)


def current_period(spark: SparkSession, path: str) -> str:
    """Name of the period that a log is written to now."""
    return max(_lines(spark, f"{path.rstrip('/')}-periods"), key=lambda p: p["number"], default={"name": "current"})["name"]


def rotate(spark: SparkSession, path: str, at: str) -> str:
    """Start a new, empty period of a log. What was written stays in its folder as an archive: no file is renamed."""
    periods = f"{path.rstrip('/')}-periods"
    number = max((p["number"] for p in _lines(spark, periods)), default=0) + 1
    name = "since_" + "".join(ch for ch in at if ch.isdigit())
    _one_line(spark, {"name": name, "number": number}).write.mode("append").text(periods)
    return name


def append_index(indexed: DataFrame, path: str) -> None:
    """Add chunks with their vectors to the persisted index; nothing is rewritten."""
    indexed.write.mode("append").parquet(path)


def clear_index(spark: SparkSession, path: str) -> None:
    """Replace the index by an empty table of the same schema."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def upsert(existing: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row per key of both tables; written to a new path by the caller."""
    both = existing.unionByName(changes, allowMissingColumns=True)
    row = F.struct(*both.columns)
    return both.groupBy(key).agg(F.max_by(row, version).alias("_r")).select("_r.*")


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Alert table, one folder per priority: the routing of the alerts."""
    alerts.write.mode("append").partitionBy("priority").parquet(path)


def publish_model(
    spark: SparkSession, model, facts: dict, folder: str, version: str, check: Callable[[str], None] | None = None
) -> str:
    """Save a model under its version, then add a line to the pointer table; the newest line counts.

    ``check`` gets the path of what was saved and may refuse it by an error, before the pointer moves.

    The line is appended by Spark's committer: it is there whole or not at all, and a failed save leaves the old model.
    """
    root = folder.rstrip("/")
    path = f"{root}/{version}"
    model.write().overwrite().save(f"{path}/pipeline")
    _one_line(spark, facts).write.mode("overwrite").text(f"{path}/facts")
    if check:
        check(path)
    number = max((p["number"] for p in _pointers(spark, root)), default=0) + 1
    _one_line(spark, {"path": path, "version": version, "number": number}).write.mode("append").text(f"{root}/pointer")
    return path


def _one_line(spark: SparkSession, value: dict) -> DataFrame:
    return spark.range(1, numPartitions=1).select(F.lit(json.dumps(value)).alias("value"))  # a constant starts no Python worker


def _pointers(spark: SparkSession, root: str) -> list[dict]:
    """One line for each model ever published."""
    return _lines(spark, f"{root}/pointer")


def _lines(spark: SparkSession, path: str) -> list[dict]:
    """Lines of a small table of pointers; none where it is absent."""
    try:
        return [json.loads(r[0]) for r in spark.read.text(path).collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def current_model(spark: SparkSession, folder: str) -> dict | None:
    """Path, version and number of the model that was published last."""
    return max(_pointers(spark, folder.rstrip("/")), key=lambda p: p["number"], default=None)


def current_model_path(spark: SparkSession, folder: str) -> str:
    found = current_model(spark, folder)
    if found is None:
        raise ValueError(f"no model was published in {folder}")
    return found["path"]
