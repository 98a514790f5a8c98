"""File sources and sinks exercised on data derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.operators import people as H
from beaconry.operators import sourcing as P
from beaconry.operators import retrieval as R
from beaconry.plans.registry import query
from beaconry.session import stored, work_path
from beaconry.sources import bindings as B
from beaconry.sources import readers, sinks


@query("src_csv", """
    SELECT event_type, COUNT(*) AS n, round(SUM(value), 2) AS total, MAX(event_id) AS last_id FROM events GROUP BY 1""")
def _csv(t):
    path = work_path(t.spark, "csv")
    rows = t.events.select("event_id", "event_type", "value", "props")
    rows.write.option("header", True).option("escape", '"').csv(path)
    back = readers.validate(readers.read_csv(t.spark, path, rows.schema), "event_type")
    return back.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("event_id").alias("last_id"))


def metric_records(t):
    """Metric records, one per day of the history."""
    m = B.metrics_history(t)
    alert = F.struct(
        F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"), F.lit(0.85).alias("threshold"),
        F.lit("warning").alias("severity"), F.lit("accuracy under the limit").alias("message"))
    return m.select(F.col("day").cast("string").alias("timestamp"), F.struct(
        F.col("accuracy").alias("accuracy"), "total_predictions",
        F.when(F.col("accuracy") < 0.85, F.array(alert)).otherwise(F.array_remove(F.array(F.lit(None).cast(
            "struct<metric:string,value:double,threshold:double,severity:string,message:string>")), F.lit(None))).alias("alerts"),
    ).alias("metrics"))


@query("src_jsonl", """
    SELECT event_type, COUNT(*) AS records, SUM((event_id % 10 = 3)::INT)::BIGINT AS malformed FROM events
    WHERE event_id % 10 <> 4 GROUP BY 1""")
def _jsonl(t):
    """Lines of three kinds: good, cut off and blank."""
    path = work_path(t.spark, "jsonl")
    k = F.col("event_id") % 10
    good = F.to_json(F.struct("event_id", "event_type", "value"))
    line = F.when(k == 3, F.concat(F.lit('{"event_type":"'), F.col("event_type"), F.lit('","val'))).when(k == 4, " ").otherwise(good)
    t.events.select(line.alias("value")).write.text(path)
    records, malformed = readers.read_jsonl(t.spark, path, "event_id bigint, event_type string, value double")
    bad = malformed.select(F.regexp_extract("value", '"event_type":"([a-z]+)"', 1).alias("event_type"), F.lit(1).alias("bad"))
    both = records.select("event_type", F.lit(0).alias("bad")).unionByName(bad)
    return both.groupBy("event_type").agg(F.count("*").alias("records"), F.sum("bad").alias("malformed"))


@query("sink_metrics", """
    SELECT CAST(day AS VARCHAR) AS "timestamp", round(accuracy, 6) AS accuracy, total_predictions,
           CASE WHEN accuracy < 0.85 THEN 1 ELSE 0 END AS n_alerts FROM metrics_history""")
def _sink_metrics(t):
    path = work_path(t.spark, "metrics")
    sinks.append_metrics(metric_records(t), path)
    good, _ = readers.read_jsonl(t.spark, path)
    return good.select("timestamp", F.round("metrics.accuracy", 6).alias("accuracy"), "metrics.total_predictions",
                       F.coalesce(F.size("metrics.alerts"), F.lit(0)).alias("n_alerts"))


@query("sink_rotate", """
    WITH n AS (SELECT SUM((day < DATE '2024-01-16')::INT)::BIGINT AS a, SUM((day >= DATE '2024-01-16')::INT)::BIGINT AS b FROM metrics_history)
    SELECT 'before' AS stage, a AS current_records, 0::BIGINT AS archived FROM n
    UNION ALL SELECT 'rotated', 0, a FROM n UNION ALL SELECT 'after', b, a FROM n""")
def _rotate(t):
    """After a rotation the current log is empty and the archive holds all; new records go to the new period."""
    path = work_path(t.spark, "rotated")
    records = metric_records(t)

    def held(stage):
        now = F.col("archive_id") == sinks.current_period(t.spark, path)
        log = t.spark.read.schema(readers.METRICS_SCHEMA + ", archive_id string").json(path)
        return log.agg(F.lit(stage).alias("stage"), F.count_if(now).alias("current_records"), F.count_if(~now).alias("archived"))

    sinks.append_metrics(records.where("timestamp < '2024-01-16'"), path)
    before = stored(held("before"), "log")
    sinks.rotate(t.spark, path, "2024-01-16")
    rotated = stored(held("rotated"), "log")
    sinks.append_metrics(records.where("timestamp >= '2024-01-16'"), path)
    return before.unionByName(rotated).unionByName(held("after"))


@query("sink_index", """
    SELECT doc_id % 2 AS part, COUNT(*) AS chunks, COUNT(DISTINCT doc_id) AS documents FROM chunk_rows GROUP BY 1""")
def _sink_index(t):
    path = work_path(t.spark, "index")
    docs = t.spread("documents", "doc_id", "text")
    for rest in (0, 1):  # two ingests
        sinks.append_index(R.index(docs.where(F.col("doc_id") % 2 == rest)), path)
    per_doc = t.spark.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy((F.col("doc_id") % 2).alias("part")).agg(
        F.sum("n").alias("chunks"), F.count("*").alias("documents"))


@query("sink_plans", """
    SELECT employee_id, COUNT(*) AS tasks, MAX(due_date) AS last_due, employee_id % 3 = 0 AS moved
    FROM (SELECT employee_id, due_date + CASE WHEN employee_id % 3 = 0 THEN 14 ELSE 0 END::INT AS due_date FROM plan_rows) GROUP BY employee_id""")
def _sink_plans(t):
    """Plans are stored, a third of them is replaced by plans with a later start."""
    path = work_path(t.spark, "plans")
    staff = B.employees(t).select("employee_id", "role", "level", "start_date")
    staff.withColumn("version", F.lit(1)).write.parquet(path)
    moved = staff.where(F.col("employee_id") % 3 == 0).select(
        "employee_id", "role", "level", F.date_add("start_date", 14).alias("start_date"), F.lit(2).alias("version"))
    kept = sinks.upsert(t.spark.read.parquet(path), moved, "employee_id", "version")
    return H.plans(kept).groupBy("employee_id").agg(
        F.count("*").alias("tasks"), F.max("due_date").alias("last_due")).withColumn("moved", F.col("employee_id") % 3 == 0)


@query("sink_alert_table", "SELECT upper(lvl) AS priority, COUNT(*) AS alerts FROM opp_advice GROUP BY 1")
def _alert_table(t):
    from beaconry.plans.sourcing import _opps

    path = work_path(t.spark, "alerts")
    sinks.write_alerts(P.alerts(P.recommend(_opps(t))), path)
    return t.spark.read.parquet(path).groupBy(F.col("priority").cast("string").alias("priority")).agg(F.count("*").alias("alerts"))


def _item_folder(t):
    """Every benchmark item as a text file of its own, in a folder of its own."""
    path = work_path(t.spark, "items")
    t.benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("value")).repartition("item").write.partitionBy(
        "item").text(path)
    return path


@query("src_text_docs", "SELECT item_id, text, CAST(length(text) AS INT) AS n_chars FROM benchmark")
def _text_docs(t):
    docs = readers.read_documents(t.spark, _item_folder(t), "faq")
    text = F.regexp_replace("text", r"\n$", "")  # the writer ends every line
    return docs.select(F.regexp_extract("filepath", r"item=(\d+)", 1).cast("bigint").alias("item_id"), text.alias("text"),
                       F.length(text).alias("n_chars"))


@query("src_directory", "SELECT 'faq' AS doc_type, COUNT(*) AS documents, COUNT(*) AS chunked FROM benchmark")
def _directory(t):
    docs = readers.read_documents(t.spark, _item_folder(t), "faq")
    report = R.ingest_report(docs, "doc_id")
    return report.agg(F.lit("faq").alias("doc_type"), F.count("*").alias("documents"), F.count_if("success").alias("chunked"))


@query("index_clear", "SELECT COUNT(*) AS before_clear, 0::BIGINT AS after_clear FROM documents")
def _index_clear(t):
    """An index is filled, read, emptied and read again."""
    path = work_path(t.spark, "cleared")
    sinks.append_index(t.documents.select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text")), path)
    before = t.spark.read.parquet(path).count()
    sinks.clear_index(t.spark, path)
    return t.spark.read.parquet(path).agg(F.lit(before).cast("bigint").alias("before_clear"), F.count("*").alias("after_clear"))
