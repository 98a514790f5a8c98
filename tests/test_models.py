"""Training, gate, publishing and robustness on a rule that a forest can learn."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from beaconry.operators import robustness as R
from beaconry.operators import training as M
from beaconry.sources import sinks

SIZE = M.ForestSize(trees=5, depth=5)
GRID = {"a": 1.0, "b": 1.0}


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(600).select(
        "id", (F.col("id") % 40).cast("double").alias("a"),
        F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") % 11).cast("double")).alias("b"),
        (F.col("id") % 40 > 20).cast("int").alias("label"))


@pytest.fixture(scope="module")
def trained(data):
    return M.train(data, "label", ["id"], SIZE, ["a", "b"])


def test_trained_model_is_good(trained, data):
    assert trained.card["accuracy"] > 0.95 and trained.medians["a"] is not None
    scored = M.batch_score(trained, data, "bank/x_v1.bin", "now")
    row = scored.first()
    assert scored.count() == 600 and row["model_version"] == "bank_x_v1" and row["a"] == row["id"] % 40
    assert M.smoke_test(trained, data)
    with pytest.raises(ValueError):
        M.batch_score(trained, data.where("id < 0"), "v", "now")


def test_gate_publishes_only_good_models(spark, data, tmp_path):
    folder = str(tmp_path / "models")
    M.train_and_publish(data, "label", ["id"], folder, "v1", 0.85, SIZE, ["a", "b"])
    first = sinks.current_model_path(spark, folder)
    noise = data.withColumn("label", (F.xxhash64("id") % 2 == 0).cast("int"))
    with pytest.raises(M.QualityGateError):
        M.train_and_publish(noise, "label", ["id"], folder, "v2", 0.85, SIZE, ["a", "b"])
    assert sinks.current_model_path(spark, folder) == first


def test_reloaded_model_scores_the_same(spark, data, tmp_path):
    """Gaps and scales are part of what is saved."""
    folder = str(tmp_path / "models")
    kept = M.train_and_publish(data, "label", ["id"], folder, "v1", 0.85, SIZE, ["a", "b"])
    again = M.load(spark, folder)
    assert (again.features, again.medians, again.scaling, again.card) == (kept.features, kept.medians, kept.scaling, kept.card)
    scored = [{r["id"]: r["prediction"] for r in m.score(data).collect()} for m in (kept, again)]
    assert scored[0] == scored[1]
    assert sum(p == (i % 40 > 20) for i, p in scored[1].items()) > 570
    odd = data.where("id < 3").withColumn("a", F.when(F.col("id") == 0, None).when(F.col("id") == 1, float("nan")).otherwise(float("inf")))
    assert {r["prediction"] for r in again.score(odd).collect()} <= {0, 1}


def test_pointer_names_the_newest_model(spark, data, tmp_path):
    folder = str(tmp_path / "models")
    assert sinks.current_model(spark, folder) is None
    with pytest.raises(ValueError):
        sinks.current_model_path(spark, folder)
    for version in ("v1", "v2", "v3"):
        M.train_and_publish(data, "label", ["id"], folder, version, 0.85, SIZE, ["a", "b"])
    assert sinks.current_model(spark, folder)["version"] == "v3" and sinks.current_model_path(spark, folder).endswith("/v3")


def test_robustness(trained, data):
    checks = {r["test_name"]: r for r in R.results(trained, data, GRID, max_flip_rate=1.0).collect()}
    assert set(checks) == {"boundary_probing", "feature_perturbation", "payload_injection", "schema_fuzzing", "output_consistency"}
    assert checks["output_consistency"]["passed"] and checks["payload_injection"]["passed"] and checks["schema_fuzzing"]["passed"]
    assert R.repeatable(trained, data).first()["unstable"] == 0
    assert {r["feature"] for r in R.perturbation(trained, data).collect()} == {"a", "b"}
    assert {r["variant"] for r in R.extremes(trained, data).collect()} == set(R.EXTREMES)


def test_derived_features_are_saved_and_know_unseen_classes(spark, tmp_path):
    data = spark.range(800).select(
        "id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 24).alias("hour"),
        F.when(F.col("id") % 90 == 0, None).otherwise(F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))).alias("kind"),
        ((F.col("id") % 4 == 1) | (F.col("id") % 24 < 3)).cast("int").alias("label"))
    derived = M.Derived(("a",), (("hour", 24.0),), ("kind",))
    folder = str(tmp_path / "models")
    kept = M.train_and_publish(data, "label", ["id"], folder, "v1", 0.9, M.ForestSize(trees=15, depth=8), ["a"], derived)
    again = M.load(spark, folder)
    assert again.derived == derived and again.card == kept.card
    odd = data.withColumn("kind", F.when(F.col("id") % 5 == 0, "never seen").otherwise(F.col("kind")))
    assert [{r["id"]: r["prediction"] for r in m.score(odd).collect()} for m in (kept, again)][0] == {
        r["id"]: r["prediction"] for r in again.score(odd).collect()}
    with pytest.raises(ValueError):
        again.score(data.drop("kind"))


def test_an_artefact_that_fails_its_check_is_not_published(spark, data, tmp_path, monkeypatch):
    folder = str(tmp_path / "models")
    monkeypatch.setattr(M, "smoke_test", lambda trained, record: False)
    with pytest.raises(M.QualityGateError):
        M.train_and_publish(data, "label", ["id"], folder, "v1", 0.85, SIZE, ["a", "b"])
    assert sinks.current_model(spark, folder) is None


def test_split_is_exact_in_every_class(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 3, "few").when(F.col("id") < 4000, "hot").otherwise("some").alias("c"))
    got = {r["c"]: (r["n"], r["t"]) for r in M.stratified_split(rows, "c", ["id"]).groupBy("c").agg(
        F.count("*").alias("n"), F.count_if("in_train").alias("t")).collect()}
    assert got == {"few": (3, 2), "hot": (3997, 3197), "some": (1000, 800)}


def test_forest_work_is_dealt_by_rows_not_files(spark, data, monkeypatch):
    """A table of one file is learned from by many tasks, and the forest keeps the node of each row."""
    seen, plain = [], M.Pipeline.fit

    def fit(self, df, params=None):
        seen.append((df.rdd.getNumPartitions(), self.getStages()[-1].getCacheNodeIds()))
        return plain(self, df, params)

    monkeypatch.setattr(M, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(M.Pipeline, "fit", fit)
    model = M.train(data.coalesce(1), "label", ["id"], SIZE, ["a", "b"])
    assert seen == [(5, True)] and model.card["accuracy"] > 0.95  # 480 of 600 rows


def test_scored_table_is_spread(spark, tables, monkeypatch):
    from beaconry.plans import models

    monkeypatch.setattr(type(tables), "spread", lambda self, name, *columns: getattr(self, name).repartition(7))
    assert models.labelled(tables, spread=True).rdd.getNumPartitions() == 7
    assert models.labelled(tables, spread=True).exceptAll(models.labelled(tables)).isEmpty()


def test_held_out_rows_are_judged_on_all_cores(spark, data, monkeypatch):
    seen, plain = [], M.Trained.score
    monkeypatch.setattr(M.Trained, "score", lambda self, df: seen.append(df.rdd.getNumPartitions()) or plain(self, df))
    assert M.train(data.coalesce(1), "label", ["id"], SIZE, ["a", "b"]).card["total_predictions"] == 120
    assert seen == [spark.sparkContext.defaultParallelism]


def test_the_gate_names_its_folder_once(tables, monkeypatch):
    from beaconry.plans import models

    class Known(Exception):
        pass

    asked = []

    def learned(t, folder=None):
        raise Known(folder)

    monkeypatch.setattr(models, "fingerprint", lambda df: asked.append(df) or df.selectExpr("'x' AS fingerprint"))
    monkeypatch.setattr(models, "trained", learned)
    with pytest.raises(Known, match="models-x"):
        models._gate(tables)
    assert len(asked) == 1


def _by_row(trained, df, **changed):
    """The plain way: every row is scored by itself."""
    return {r["id"]: r["prediction"] for r in trained.score(df.withColumns(changed)).collect()}


def test_cells_give_every_row_the_class_it_gets_alone(trained, data):
    """Nulls, NaN, infinite values and values on a threshold."""
    cuts = [c * trained.scaling["a"][1] + trained.scaling["a"][0] for c in trained.cuts[0]]
    odd = data.withColumn("a", F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 9 == 1, float("nan")).when(
        F.col("id") % 9 == 2, float("inf")).when(F.col("id") % 9 == 3, -float("inf")).when(
        F.col("id") % 9 == 4, F.get(F.array(*[F.lit(c) for c in cuts]), (F.col("id") % len(cuts)).cast("int"))).otherwise(F.col("a")))
    celled = trained.cell(odd, "cell")
    got = celled.join(trained.score_cells(celled, "cell"), "cell").collect()
    assert {r["id"]: r["prediction"] for r in got} == _by_row(trained, odd) and len(got) == 600
    with pytest.raises(ValueError):
        trained.cell(data.drop("a"), "cell")


def test_cell_is_the_number_of_thresholds_below(spark):
    data = spark.range(900).select(
        "id", *[((F.col("id") * k) % 37).cast("double").alias(f"x{k}") for k in (1, 5, 11, 23)]).withColumn(
        "label", ((F.col("x1") + F.col("x5") > 40) | (F.col("x11") * F.col("x23") > 500)).cast("int"))
    names = [c for c in data.columns if c.startswith("x")]
    model = M.train(data, "label", ["id"], M.ForestSize(trees=9, depth=8), names)
    assert sorted(model.cuts) == [0, 1, 2, 3]
    for r in model.model.transform(model.cell(data, "cell")).collect():
        assert r["cell"] == [sum(c < x for c in model.cuts[i]) for i, x in enumerate(r["_features"])]
    celled = model.cell(data, "cell")
    got = {r["id"]: r["prediction"] for r in celled.join(model.score_cells(celled, "cell"), "cell").collect()}
    base = _by_row(model, data)
    assert got == base and set(base.values()) == {0, 1}
    flips = {f: sum(base[i] != p for i, p in _by_row(model, data, **{f: F.col(f) * 1.2}).items()) for f in names}
    assert sum(flips.values()) > 20 and {r["feature"]: r["flips"] for r in R.perturbation(model, data, 1.2).collect()} == flips


def test_perturbation_counts_as_if_every_row_was_scored(trained, data):
    base = _by_row(trained, data)
    flips = {f: sum(base[i] != p for i, p in _by_row(trained, data, **{f: F.col(f) * 1.3}).items()) for f in ("a", "b")}
    assert flips["a"] > 0
    assert {r["feature"]: (r["records"], r["flips"], r["flip_rate"]) for r in R.perturbation(trained, data, 1.3).collect()} == {
        f: (600, n, n / 600) for f, n in flips.items()}
    assert {tuple(r) for r in R.perturbation(trained, data.where("id < 0")).collect()} == {("a", 0, 0, None), ("b", 0, 0, None)}


def test_cells_know_classes_of_categories(spark):
    data = spark.range(400).select(
        "id", (F.col("id") % 7).cast("double").alias("a"),
        F.when(F.col("id") % 90 == 0, None).otherwise(F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))).alias("kind"),
        ((F.col("id") % 4 == 1) | (F.col("id") % 7 < 2)).cast("int").alias("label"))
    model = M.train(data, "label", ["id"], M.ForestSize(trees=9, depth=6), ["a"], M.Derived(categories=("kind",)))
    celled = model.cell(data, "cell")
    got = celled.join(model.score_cells(celled, "cell"), "cell").collect()
    assert {r["id"]: r["prediction"] for r in got} == _by_row(model, data) and len(got) == 400


def test_perturbation_scores_each_cell_once(trained, data, monkeypatch):
    """The forest sees as many rows as there are cells, however many records lie in them."""
    seen, plain = [], M.Trained.score_cells

    def scored(self, cells, name):
        out = plain(self, cells, name)
        seen.append(out.count())
        return out

    monkeypatch.setattr(M.Trained, "score_cells", scored)
    for times in (1, 5):
        many = data.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
        assert {r["records"] for r in R.perturbation(trained, many, 1.3).collect()} == {600 * times}
    assert seen[0] == seen[1] and 0 < seen[0] < 600


def test_publishing_wraps_no_tree_in_python(spark, data, tmp_path, monkeypatch):
    from pyspark.ml.classification import RandomForestClassificationModel as Forest

    monkeypatch.setattr(Forest, "trees", property(lambda self: pytest.fail("every tree was listed")))
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("a Python worker was started for one line"))
    folder = str(tmp_path / "models")
    M.train_and_publish(data, "label", ["id"], folder, "v1", 0.85, SIZE, ["a", "b"])
    assert sinks.current_model(spark, folder)["version"] == "v1" and M.load(spark, folder).features == ("a", "b")


def test_cells_of_a_published_model_save_no_forest(spark, data, tmp_path, monkeypatch):
    """Published, or loaded again: the thresholds are read where the model lies."""
    folder = str(tmp_path / "models")
    kept = M.train_and_publish(data, "label", ["id"], folder, "v1", 0.85, SIZE, ["a", "b"])
    expected = M.Trained(kept.model, kept.features, kept.medians, kept.scaling, kept.card).cuts
    monkeypatch.setattr(M, "work_path", lambda *a: pytest.fail("the forest was saved once more"))
    assert kept.cuts == M.load(spark, folder).cuts == expected and expected[0]


def test_a_trained_model_is_not_loaded_once_more(tables, monkeypatch):
    from beaconry.plans import models

    made = object()
    monkeypatch.setattr(models.M, "train_and_publish", lambda *a, **b: made)
    monkeypatch.setattr(models.M, "load", lambda *a: pytest.fail("the new model was loaded again"))
    assert models.trained(tables, "/nowhere/models-none") is made


def _scored_rows(monkeypatch):
    """The rows that the forest scores, one number for each of its scorings."""
    seen, plain = [], M.Trained.class_of

    def scored(self, cells, cell, name):
        seen.append(cells.count())
        return plain(self, cells, cell, name)

    monkeypatch.setattr(M.Trained, "class_of", scored)
    return seen


@pytest.mark.parametrize("check, scorings", [(R.extremes, 1), (R.repeatable, 5)])
def test_extremes_and_repeats_score_each_cell_not_each_row(trained, data, monkeypatch, check, scorings):
    seen = _scored_rows(monkeypatch)
    for times in (1, 5):
        many = data.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
        assert {r["records"] for r in check(trained, many).collect()} == {600 * times}
    assert len(seen) == 2 * scorings and len(set(seen)) == 1 and 0 < seen[0] < 600
    assert {r["records"] for r in check(trained, data.where("id < 0")).collect()} == {0}


def test_extremes_count_as_if_every_row_was_scored(trained, data, monkeypatch):
    """Only class 1 is known here, so the rows of class 0 are the bad ones."""
    monkeypatch.setattr(R, "CLASSES", (1,))
    shapes = {"zero": lambda c: F.lit(0.0), "huge": lambda c: F.abs(c) * 1e9, "negative": lambda c: -F.abs(c), "infinite": lambda c: F.lit(float("inf"))}
    bad = {v: sum(p != 1 for p in _by_row(trained, data, **{f: shape(F.col(f)) for f in ("a", "b")}).values()) for v, shape in shapes.items()}
    assert set(bad.values()) - {0, 600}  # some variant has both classes
    assert {r["variant"]: (r["records"], r["bad"]) for r in R.extremes(trained, data).collect()} == {v: (600, n) for v, n in bad.items()}


def test_repeats_find_a_scoring_and_a_preparation_that_differ(trained, data, monkeypatch):
    base = _by_row(trained, data)
    with monkeypatch.context() as m:  # the fourth scoring gives every row class 1
        plain = M.Trained.class_of
        m.setattr(M.Trained, "class_of", lambda self, cells, cell, name: plain(self, cells, cell, name).withColumn(
            name, F.lit(1) if cell == "_r3" else F.col(name)))
        assert tuple(R.repeatable(trained, data).first()) == (600, sum(p != 1 for p in base.values()))
    cell = M.Trained.cell  # the third time, every row is prepared as one with a = 39
    monkeypatch.setattr(M.Trained, "cell", lambda self, df, name: cell(self, df.withColumn("a", F.lit(39.0)) if name == "_r2" else df, name))
    moved = _by_row(trained, data, a=F.lit(39.0))
    assert tuple(R.repeatable(trained, data).first()) == (600, sum(base[i] != moved[i] for i in base)) and base != moved


def test_batch_score_gives_every_record_back(spark, trained, tmp_path, monkeypatch):
    """One row for each record, of records that come twice too, with its key, features and prediction."""
    from beaconry.plans import models
    from beaconry.sources.tables import Tables

    lines = spark.range(20).selectExpr(
        "cast(id div 2 as bigint) AS l_orderkey", "cast(id % 2 as int) AS l_linenumber", "double(100 * (id div 4)) AS l_extendedprice",
        "cast(id % 5 as bigint) AS l_suppkey", "double(id % 7) AS l_quantity", "0.01D * (id % 11) AS l_discount", "'R' AS l_returnflag",
        "timestamp_ntz'1996-01-01 00:00:00' AS l_shipdate")
    lines.union(lines.where("l_orderkey = 3")).write.parquet(str(tmp_path / "lineitem.parquet"))
    renamed = M.train(spark.range(200).selectExpr(
        "id", "double(id % 20) AS transaction_amount", "double(id % 3) AS account_age", "double(id % 7) AS num_transactions",
        "double(id % 2) AS merchant_risk", "cast(id % 20 > 9 as int) AS label"), "label", ["id"], SIZE, models._FEATURES)
    monkeypatch.setattr(models, "trained", lambda t: renamed)
    got = models._score(Tables(spark, str(tmp_path)))
    assert got.columns == ["l_orderkey", "l_linenumber", *models._FEATURES, "prediction", "model_version", "scored_at"]
    rows = sorted((r["l_orderkey"], r["l_linenumber"]) for r in got.collect())
    assert rows == sorted([(i // 2, i % 2) for i in range(20)] + [(3, 0), (3, 1)])
    assert {(r["model_version"], r["scored_at"]) for r in got.collect()} == {("bank_a_fraud_v1", "2024-01-31T00:00:00")}
    assert {r["prediction"] for r in got.collect()} <= {0, 1}
