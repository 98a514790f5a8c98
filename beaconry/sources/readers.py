"""Readers for files: CSV, JSON lines, text documents and catalogues."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS_SCHEMA = (
    "timestamp string, metrics struct<accuracy: double, precision: double, recall: double, f1: double, "
    "confusion_matrix: array<array<bigint>>, total_predictions: bigint, "
    "alerts: array<struct<metric: string, value: double, threshold: double, severity: string, message: string>>>"
)
DOCUMENT_SUFFIXES = ("txt", "md", "json")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header; without a schema the types are inferred by one more pass."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def validate(df: DataFrame, label: str | None = None) -> DataFrame:
    """Refuse a table without rows or without the label column."""
    if label is not None and label not in df.columns:
        raise ValueError(f"label column {label!r} is missing; found {df.columns}")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def check_files(
    spark: SparkSession, folder: str, expected: DataFrame, label: str, dataset_pattern: str = r"([^/]+)/[^/]+$"
) -> DataFrame:
    """What is wrong with each delivered dataset of CSV files with a header: dataset, n_files, n_rows, reason (null: nothing).

    ``dataset_pattern`` takes a dataset's name from a file's path (by default its folder); ``expected`` has the names that must
    be there in ``dataset``. The reasons, the first that applies: ``missing`` (no file, or only files of no bytes, which Spark's
    readers pass over), ``empty`` (blank lines only),
    ``no label`` (a header without that column), ``no rows``. Files are only scanned, however large: lines are counted by file
    before they move, and a header is the first line of the split that starts its file. A dataset nobody expects is judged too.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"), "value")
    read = lines.groupBy("file").agg(
        F.min_by("value", F.when(F.col("start") == 0, F.col("place"))).alias("header"), F.count_if(F.trim("value") != "").alias("n"))
    names = F.transform(F.split("header", ","), lambda c: F.btrim(c, F.lit(' "\r\ufeff')))
    per_file = read.select(
        F.regexp_extract("file", dataset_pattern, 1).alias("dataset"), (F.col("n") > 0).alias("filled"),
        F.greatest(F.col("n") - 1, F.lit(0)).alias("n"), F.array_contains(names, label).alias("labelled"))
    found = per_file.groupBy("dataset").agg(
        F.count("*").alias("n_files"), F.sum("n").alias("n_rows"),
        F.bool_or("filled").alias("filled"), F.bool_and(F.when(F.col("filled"), F.col("labelled"))).alias("labelled"))
    both = expected.select("dataset").distinct().join(found, "dataset", "full_outer")
    reason = (
        F.when(F.col("n_files").isNull(), "missing").when(~F.col("filled"), "empty")
        .when(~F.col("labelled"), "no label").when(F.col("n_rows") == 0, "no rows"))
    return both.select("dataset", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                       reason.alias("reason"))


def read_jsonl(spark: SparkSession, path: str, schema: str = METRICS_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Good records and the malformed lines; blank lines are skipped. A record is a JSON object and nothing else.

    Lines are read as text once, so both outputs come from the same scan definition.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = F.json_object_keys("value").isNull()  # null for anything but a whole object
    parsed = lines.select("value", bad.alias("bad"), F.when(~bad, F.from_json("value", schema)).alias("r"))
    return parsed.where(~F.col("bad")).select("r.*"), parsed.where("bad").select("value")


def read_documents(spark: SparkSession, folder: str, doc_type: str = "policy") -> DataFrame:
    """Every supported file below a folder as one row: path, name, type and whole text.

    A JSON file gives its ``content`` field, or its whole text where it has none.
    """
    pattern = "*.{" + ",".join(DOCUMENT_SUFFIXES) + "}"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    path = F.input_file_name()
    content = F.try_variant_get(F.try_parse_json("value"), "$.content", "string")
    text = F.when(F.lower("filepath").endswith(".json"), F.coalesce(content, F.col("value"))).otherwise(F.col("value"))
    return files.select(path.alias("filepath"), "value").select(
        F.substring(F.md5(F.col("filepath").cast("binary")), 1, 12).alias("doc_id"),
        F.substring_index("filepath", "/", -1).alias("filename"), F.lit(doc_type).alias("doc_type"), "filepath",
        text.alias("text"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Health plans of a benefits catalogue as rows (plan, tier, amounts); the defaults where the
    file is absent or broken. A catalogue is one small configuration file."""
    from beaconry.operators.people import plan_table

    try:
        raw = spark.read.text(path, wholetext=True).first()[0]
        plans = json.loads(raw)["health_plans"]
        rows = [
            (name, tier, float(v.get("employer_monthly_premium", 0)), float(v.get("employee_monthly_premium", 0)),
             v.get("deductible"), v.get("oop_max"), v.get("copay"), bool(plan.get("hsa_eligible", False)))
            for name, plan in plans.items() for tier, v in plan.get("tiers", {}).items()]
        rows = [(*r[:4], *[None if x is None else float(x) for x in r[4:7]], r[7]) for r in rows]
        return spark.createDataFrame(rows, plan_table(spark).schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return plan_table(spark)
    except (AttributeError, KeyError, TypeError, ValueError):  # the file is there, but it is no catalogue
        return plan_table(spark)
