"""Sources, sinks and streams over files; a stream must equal the batch result."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from beaconry.operators import drift, history, kpi
from beaconry.sources import bindings as B
from beaconry.sources import readers, sinks
from beaconry.streaming import flows, runner, state


def test_csv_and_validation(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x,label\n1.5,a\n2,\xff\n")
    df = readers.validate(readers.read_csv(spark, str(tmp_path / "a.csv")), "label")
    assert df.count() == 2 and dict(df.dtypes)["x"] == "double"
    with pytest.raises(ValueError):
        readers.validate(df, "absent")
    with pytest.raises(ValueError):
        readers.validate(df.where("x > 9"))


def test_metric_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"timestamp":"t1","metrics":{"accuracy":0.9}}\n\n{broken\n{"timestamp":"t2","metrics":{"accuracy":0.8}}\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "log.jsonl"))
    assert [r["timestamp"] for r in good.orderBy("timestamp").collect()] == ["t1", "t2"] and bad.count() == 1
    flat = good.select("timestamp", "metrics.accuracy")
    assert history.latest(flat, "timestamp").first()["accuracy"] == 0.8
    assert [r["timestamp"] for r in history.last_n(flat, "timestamp", 1).collect()] == ["t2"]


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("Alpha\nbeta")
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"content": "inner text"}))
    (tmp_path / "sub" / "c.json").write_text(json.dumps({"other": 1}))
    (tmp_path / "d.bin").write_text("skip")
    rows = {r["filename"]: r["text"] for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": "Alpha\nbeta", "b.json": "inner text", "c.json": '{"other": 1}'}


def test_catalogue(spark, tmp_path):
    assert readers.read_catalogue(spark, str(tmp_path / "none.json")).count() == 9
    (tmp_path / "c.json").write_text(json.dumps({"health_plans": {"X": {"hsa_eligible": True, "tiers": {"family": {"employee_monthly_premium": 7}}}}}))
    row = readers.read_catalogue(spark, str(tmp_path / "c.json")).first()
    assert (row["plan_name"], row["employee_premium"], row["deductible"], row["hsa_eligible"]) == ("X", 7.0, None, True)


def test_index_clear_keeps_the_schema(spark, frame, tmp_path):
    path = str(tmp_path / "index")
    df = frame("doc_id bigint, chunk_index int", (1, 0))
    sinks.append_index(df, path)
    sinks.append_index(df, path)
    assert spark.read.parquet(path).count() == 2
    sinks.clear_index(spark, path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == df.columns


@pytest.fixture(scope="module")
def parts(spark, tables, tmp_path_factory):
    """The events in four files, in order of time."""
    path = str(tmp_path_factory.mktemp("events") / "events.parquet")
    for i in range(4):
        tables.events.where(F.floor(F.col("event_id") * 4 / tables.events.count()) == i).coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_of_many_batches_equals_batch(spark, tables, parts):
    stream = runner.read_stream(spark, parts, 1).select("ts", F.col("user_id").cast("string").alias("tenant_id"))
    rows = runner.run(flows.daily_usage(stream), "usage", "update")
    assert rows.select("batch_id").distinct().count() >= 4
    got = runner.newest(rows, ["day", "tenant_id"]).select("day", "tenant_id", "calls")
    want = tables.events.groupBy(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("tenant_id")).agg(F.count("*").alias("calls"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_kpi_stream_equals_batch(spark, tables, parts):
    daily = runner.newest(runner.run(flows.daily_kpis(runner.read_stream(spark, parts, 1)), "kpi", "update"), ["day"])
    got, want = (sorted((r["metric_name"], round(r["z_score"], 9)) for r in kpi.z_scores(kpi.to_history(d)).collect())
                 for d in (daily, B.daily_kpi(tables)))
    assert got == want


def test_cooldown_state_crosses_batches(spark, parts, tables):
    at = F.unix_seconds(runner.utc_instant(F.col("ts")))
    stream = runner.read_stream(spark, parts, 1).select(
        F.col("event_type").alias("model_id"), F.col("event_id").alias("cycle_id"), at.alias("at"), (F.col("value") > 60).alias("any_drift"))
    got = state.cooldown_decisions(stream).groupBy("model_id", "decision").agg(F.count("*").alias("n"))
    cycles = tables.events.select(F.col("event_type").alias("model_id"), at.alias("at"), (F.col("value") > 60).alias("any_drift"))
    want = history.retrain_decisions(cycles.dropDuplicates(["model_id", "at"])).groupBy("model_id", "decision").agg(F.count("*").alias("n"))
    fired = "decision = 'retraining_triggered'"
    assert got.where(fired).exceptAll(want.where(fired)).isEmpty() and want.where(fired).exceptAll(got.where(fired)).isEmpty()


def test_drift_of_closed_days_equals_batch(spark, tables, parts):
    closed = runner.run(flows.value_counts(runner.read_stream(spark, parts, 1)), "counts")
    days = [r[0] for r in closed.select("day").distinct().collect()]
    current = tables.events.where(F.to_date("ts").isin(days)).select("value")
    baseline = tables.events.where("event_id % 3 = 0").select((F.col("value") * 1.1).alias("value"))
    got = drift.ks_from_counts(baseline.groupBy("value").agg(F.count("*").alias("n")), closed, "value", "n").collect()
    assert got == drift.ks_drift(baseline, current).collect()
    assert closed.agg(F.sum("n")).first()[0] == current.count()


def test_drift_sees_days_still_open(spark, frame, tmp_path):
    """The last day, which no watermark closes, counts like the others."""
    from beaconry.plans import load_all

    rows = [(f"2024-01-{d:02d} 10:00:00", float(i)) for d in (10, 20) for i in range(50)]
    rows += [("2024-01-25 10:00:00", 1000.0 + i) for i in range(50)]
    events = frame("ts string, value double", *rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = load_all()["st_drift"](spark, str(tmp_path)).first()
    assert got["ks_statistic"] == 0.5 and got["drift_detected"]


def test_memory_is_cleared_and_replaced(spark, tmp_path):
    schema = "conv_id long, turn long, question string, answered boolean, clears boolean"
    batches = [[(1, t, f"q{t}", t != 3, False) for t in range(9)] + [(2, 0, "x", True, False)],
               [(1, 9, "forget", True, True), (1, 10, "later", True, False), (2, 1, "gone", True, True)]]
    out, checkpoint, feed = (str(tmp_path / n) for n in ("out", "state", "feed"))
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(feed)
        with runner.rocksdb_state(spark, expiring=True):
            got = runner.run(state.conversation_memory(spark.readStream.schema(schema).parquet(feed), 4), "m", "update", out=out, checkpoint=checkpoint)
        now = {(r["conv_id"], r["age"]): r["turn"] for r in runner.newest(got, ["conv_id", "age"]).where("turn is not null").collect()}
        assert now == ({(1, 1): 8, (1, 2): 7, (1, 3): 6, (1, 4): 5, (2, 1): 0} if rows is batches[0] else {(1, 1): 10})


def test_chi_squared_tail_and_pooling(spark):
    def even(x, k):  # a finite sum where the degrees of freedom are even
        return math.fsum(math.exp(-x / 2 + j * math.log(x / 2) - math.lgamma(j + 1)) for j in range(k // 2))

    known = [(3.841459, 1, 0.05), (6.634897, 1, 0.01), (0.5, 3, 0.918891), (0.0, 4, 1.0), (2.0, 0, 1.0)]
    known += [(x, k, even(x, k)) for x, k in ((18.307038, 10), (129.561197, 100), (1000.0, 1000), (1200.0, 1000), (5000.0, 10))]
    df = spark.createDataFrame([(x, k, p) for x, k, p in known], "x double, k long, p double")
    for r in df.withColumn("got", drift.chi_squared_p_value(F.col("x"), F.col("k"))).collect():
        assert abs(r["got"] - r["p"]) < 1e-6, r
    rows = [("baseline", "a")] * 60 + [("baseline", None)] * 40 + [("current", "a")] * 30 + [("current", None)] * 20
    rows += [("baseline", f"r{i}") for i in range(6)] + [("current", f"s{i}") for i in range(3)]
    got = drift.chi_squared_drift(spark.createDataFrame(rows, "side string, c string"), "side", "baseline", ["c"]).first()
    assert got["freedom"] == 2 and got["chi_squared"] == pytest.approx(0.0, abs=0.01) and not got["drift_detected"]


def test_check_files_names_the_first_fault(spark, tmp_path):
    root = tmp_path / "in"
    for name, text in {
        "good/a": "x,label\n1,2\n\n3,4\n", "good/b": '\ufeff"x","label"\r\n5,6\r\n', "nolabel/a": "x,labels\n1,label\n", "header/a": "label,x",
        "zero/a": "", "zero/b": "", "blank/a": "\n \n", "mixed/a": "", "mixed/b": "label\n1\n", "half/a": "label\n1\n", "half/b": "y\nlabel\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / f"{name}.csv").write_text(text, newline="")
    long = "\n".join(["x,label", *(f"{i},label" for i in range(60_000))])  # several splits
    (root / "long").mkdir()
    (root / "long/a.csv").write_text(long)
    expected = spark.createDataFrame([(n,) for n in ("good", "gone", "long", "good", "zero", None)], "dataset string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = {r.dataset: (r.n_files, r.n_rows, r.reason) for r in readers.check_files(spark, str(root), expected, "label").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {
        "good": (2, 3, None), "nolabel": (1, 1, "no label"), "header": (1, 0, "no rows"), "zero": (0, 0, "missing"), "blank": (1, 0, "empty"),
        "mixed": (1, 1, None), "half": (2, 2, "no label"), "long": (1, 60_000, None), "gone": (0, 0, "missing"), None: (0, 0, "missing")}


def test_refusals_name_the_columns(spark):
    from beaconry.operators import drift, scorecard

    df = spark.createDataFrame([(1, 1, None), (2, 0, 5.0)], "id int, actual int, x double")
    assert scorecard.refusal(df, "actual", "prediction") == "missing columns: prediction"
    assert scorecard.refusal(df, "actual") is None
    rows = drift.shared_features(df, df.limit(0), "actual").collect()
    assert sorted(tuple(r) for r in rows) == [("id", 2, 0), ("x", 1, 0)]
    with pytest.raises(ValueError):
        drift.shared_features(df, df.select("actual"), "actual")
