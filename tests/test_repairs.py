"""Rules that once were broken: caps, fingerprints, readers, shared folders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from beaconry import session
from beaconry.operators import people, profile, reports
from beaconry.operators import assistant as A
from beaconry.sources import readers


def test_profiles_cover_every_column(spark):
    df = spark.range(50).select(*[(F.col("id") * k).alias(f"n{k}") for k in range(12)],
                                *[F.concat(F.lit("t"), F.col("id") % k).alias(f"c{k}") for k in range(1, 11)])
    assert profile.numeric_summary(df).count() == 12
    assert {r["column_name"] for r in profile.categorical_top(df).collect()} == {f"c{k}" for k in range(1, 11)}
    assert profile.numeric_summary(df, columns=["n3"]).count() == 1


def test_most_frequent_values_of_long_texts(frame):
    long = "x" * 5000
    df = frame("t string", *[(long + "a",)] * 3, *[(long + "b",)] * 2, ("z",), (None,))
    rows = profile.categorical_top(df).orderBy("place").collect()
    assert [r["n"] for r in rows] == [3, 2, 1] and rows[0]["unique_values"] == 3 and rows[0]["value"] == "x" * 64


def test_fingerprint_tells_rows_apart(frame):
    def of(*rows):
        return profile.fingerprint(frame("a string, b string", *rows)).first()["fingerprint"]

    prints = [of(("x|y", "z")), of(("x", "y|z")), of((None, "z")), of(("~", "z")), of(("", "z")), of(("n", "z")), of(("s1:x", None)),
              of(("x", "z"), ("x", "z")), of(("x", "z"))]
    assert len(set(prints)) == len(prints)
    assert of(("a", "b"), ("c", "d")) == of(("c", "d"), ("a", "b"))
    by = profile.fingerprint(frame("a string, b string", ("k", "1"), ("l", "1"), ("l", "1")), by=["a"])
    assert by.count() == 2


def test_json_lines_must_be_objects(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"timestamp": "t", "metrics": {"accuracy": 0.5}}\n[1,2]\n5\n"x"\n{broken\n\n null \n')
    good, bad = readers.read_jsonl(spark, str(path))
    assert [r["metrics"]["accuracy"] for r in good.collect()] == [0.5]
    assert bad.count() == 5


def test_catalogue_defaults_only_where_absent_or_malformed(spark, tmp_path):
    n = len(people.HEALTH_PLANS)
    assert readers.read_catalogue(spark, str(tmp_path / "none.json")).count() == n
    (tmp_path / "bad.json").write_text("{not json")
    assert readers.read_catalogue(spark, str(tmp_path / "bad.json")).count() == n
    with pytest.raises(Exception, match="nosuchfs"):
        readers.read_catalogue(spark, "nosuchfs://x/y.json")


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        conf = Context()
        sparkContext = Context()

    class NoDir:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

    Context._jsc = NoDir()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_reports_say_what_they_leave_out(frame):
    raw = '{"exec_summary": "s", "key_metrics": [{"label": "a", "value": "1"}, {"label": "b", "value": "2"}], "risk_flags": ["x", "y", "z"]}'
    df = frame("raw string", (raw,))
    row = reports.parse_reports(df, longest=2).first()
    assert row["risk_flags"] == ["x", "y"] and row["n_dropped"] == 1
    assert reports.parse_reports(df).first()["n_dropped"] == 0
    shown = reports.render_reports(reports.parse_reports(df), metrics_shown=1).first()
    assert shown["metrics_hidden"] == 1 and "- b" not in shown["report_text"]


def test_prompts_and_titles_are_tables(spark, frame):
    asked = frame("conv_id long, turn long, question string", (1, 1, "pto days"), (1, 2, "hello"))
    prompts = frame("intent string, place int, prompt string", ("leave", 0, "own"), (None, 0, "any"), (None, 1, "other"))
    got = sorted((r["turn"], r["place"], r["prompt"]) for r in A.followups(asked, prompts).collect())
    assert got == [(1, 0, "own"), (2, 0, "any"), (2, 1, "other")]
    staff = spark.sql("SELECT 1L AS employee_id, date'2024-01-01' AS start_date, 'x' AS role, 'junior' AS level")
    titles = frame("task_id string, title string", ("d1_01", "First"))
    named = {r["task_id"]: r["title"] for r in people.plans(staff, titles=titles).collect()}
    assert named["d1_01"] == "First" and named["d1_02"] == "d1_02"


def test_leave_is_rounded_half_even_at_the_end(spark):
    staff = spark.sql("SELECT 1 AS e, date'2020-01-01' AS hire_date, 0.0D AS pto_used, 'part_time_50' AS employment_type "
                      "UNION ALL SELECT 2, date'2020-01-01', 0.05D, 'full_time'")
    rows = {r["e"]: r for r in people.pto_balance(staff, "2024-04-01").collect()}
    assert rows[1]["accrued_days"] == 2.6  # 2.625
    assert rows[2]["remaining_days"] == 5.2  # 5.25 - 0.05


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    """The caller's output and checkpoint make a run resumable; old files are not read again."""
    from beaconry.streaming import runner

    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(3).write.parquet(folder)
    first = runner.run(runner.read_stream(spark, folder, 1), "t", out=out, checkpoint=check)
    assert sorted(r["id"] for r in first.collect()) == [0, 1, 2]
    spark.range(10, 12).write.mode("append").parquet(folder)
    again = runner.run(runner.read_stream(spark, folder, 1), "t", out=out, checkpoint=check)
    assert sorted(r["id"] for r in again.collect()) == [0, 1, 2, 10, 11]
    with pytest.raises(ValueError):
        runner.run(runner.read_stream(spark, folder), "t", out=out)


def test_keys_of_one_side_are_counted(spark):
    from beaconry.operators import scorecard

    a, b = spark.range(5).withColumnRenamed("id", "k"), spark.range(3, 9).withColumnRenamed("id", "k")
    assert {r["side"]: r["n"] for r in scorecard.coverage(a, b, "k").collect()} == {"both": 2, "prediction only": 3, "actual only": 4}


def test_forest_sample_is_the_smallest_hashes(spark):
    from beaconry.operators import outlier_forest as I

    df = spark.range(5000).select("id", (F.col("id") % 97).cast("double").alias("v"))
    small = I.fit(df, ["v"], ["id"], trees=4, sample=64)
    assert {r["sample_size"] for r in small.select("sample_size").distinct().collect()} == {64}
    assert small.exceptAll(I.fit(df.repartition(7), ["v"], ["id"], trees=4, sample=64)).count() == 0
