"""The forest grown from counts by cell, against Spark's own trees and against every row scored by itself."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from beaconry.operators import cell_forest as C
from beaconry.operators import training as M

NAMES = ["x5", "x11", "x23"]
SIZE = M.ForestSize(trees=9, depth=8)


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(3000).select("id", *[((F.col("id") * k) % p).cast("double").alias(f"x{k}") for k, p in ((5, 29), (11, 31), (23, 17))]).withColumn(
        "label", ((F.col("x5") + F.col("x11") > 30) != (F.col("id") % 13 == 0)).cast("int"))


@pytest.fixture()
def by_cell(monkeypatch):
    """Small tables are counted by cell too, and Spark's forest must not pass over rows."""
    monkeypatch.setattr(M, "ROWS_AS_THEY_ARE", 0)
    monkeypatch.setattr(M.Pipeline, "fit", lambda *a: pytest.fail("a pass over the rows for each level"))


def _counts(rows):
    """Places, counts by class and cuts of rows of few values."""
    cuts = [[(a + b) / 2 for a, b in zip(v[:-1], v[1:])] for v in (sorted({r[n] for r in rows}) for n in NAMES)]
    places = np.array([[sum(c < r[n] for c in cs) for n, cs in zip(NAMES, cuts)] for r in rows])
    cells, at = np.unique(places, axis=0, return_inverse=True)
    n = np.zeros((2, len(cells)))
    np.add.at(n, (np.array([r["label"] for r in rows]), at.ravel()), 1)
    return cells.astype(np.uint8), n, cuts


def test_a_tree_of_all_rows_is_sparks_tree(spark, data, tmp_path):
    """No draws and all features: the same nodes, numbers and class sums as Spark's tree on weighted rows."""
    rows = data.collect()
    weighted = VectorAssembler(inputCols=NAMES, outputCol="v").transform(data.withColumn("w", F.when(F.col("label") == 1, 0.5).otherwise(2.0)))
    plain = DecisionTreeClassifier(labelCol="label", featuresCol="v", weightCol="w", maxDepth=6, minInstancesPerNode=5).fit(weighted)
    plain.write().save(str(tmp_path / "plain"))
    expected = [r[0] for r in spark.read.parquet(str(tmp_path / "plain" / "data")).orderBy("id").select(F.struct("*")).collect()]
    cells, n, cuts = _counts(rows)
    tree = C.Tree(cells, n, np.array([2.0, 0.5]), 32, 3, 6, 5, np.random.default_rng(0)).rows(0, cuts).to_pylist()
    assert len(tree) == len(expected) > 20
    for mine, other in zip(sorted(tree, key=lambda r: r["id"]), expected):
        assert (mine["id"], mine["prediction"], mine["low"], mine["high"], mine["rows"], mine["feature"], mine["cut"]) == (
            other["id"], other["prediction"], other["leftChild"], other["rightChild"], other["rawCount"],
            other["split"]["featureIndex"], other["split"]["leftCategoriesOrThreshold"])
        assert mine["stats"] == pytest.approx(other["impurityStats"]) and mine["gain"] == pytest.approx(other["gain"], abs=1e-9)
        assert other["impurity"] < 0 or mine["impurity"] == pytest.approx(other["impurity"])  # Spark's -1: a leaf without a fitting split


def test_a_large_table_is_counted_by_cell(spark, data, by_cell, monkeypatch, tmp_path):
    """Five times the rows give the forest no more cells, the published model scores as before it was saved, partitions don't matter."""
    seen, plain = [], C.np.unique
    monkeypatch.setattr(C.np, "unique", lambda *a, **b: seen.append(len(plain(a[0]))) or plain(*a, **b))
    for times in (1, 5):
        many = data.where("id < 600").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
        M.train(many, "label", ["id"], SIZE, NAMES)
    assert seen[0] == seen[1] < 600
    kept = M.train_and_publish(data, "label", ["id"], str(tmp_path / "models"), "v1", 0.8, SIZE, NAMES)
    again, other = M.load(spark, str(tmp_path / "models")), M.train(data.repartition(7), "label", ["id"], SIZE, NAMES)
    scored = [{r["id"]: r["prediction"] for r in m.score(data).collect()} for m in (kept, again, other)]
    assert scored[0] == scored[1] == scored[2] and set(scored[0].values()) == {0, 1}
    assert kept.card == again.card and 0.85 < kept.card["accuracy"]


def test_accuracy_is_that_of_sparks_forest(data, monkeypatch):
    plain = M.train(data, "label", ["id"], M.ForestSize(trees=30, depth=12), NAMES)
    monkeypatch.setattr(M, "ROWS_AS_THEY_ARE", 0)
    grown = M.train(data, "label", ["id"], M.ForestSize(trees=30, depth=12), NAMES)
    assert isinstance(grown.model.stages[-1], RandomForestClassificationModel) and grown.nodes and not plain.nodes
    assert grown.model.stages[-1].getNumTrees == 30 and abs(grown.card["accuracy"] - plain.card["accuracy"]) < 0.03


def test_all_rows_are_drawn_with_their_counts(spark, by_cell, data):
    """The roots hold as many drawn rows as there are rows, within what chance allows."""
    trained = M.train(data, "label", ["id"], SIZE, NAMES)
    roots = [r["rawCount"] for r in spark.read.parquet(f"{trained.nodes}/data").select("nodeData.*").where("id = 0").collect()]
    assert len(roots) == 9 and len(set(roots)) > 1 and all(abs(n - 2400) < 6 * 2400 ** 0.5 for n in roots)


def test_thresholds_see_every_row(spark):
    """Far values, values that are half of the rows, few values and one value."""
    df = spark.range(20_000).select(
        F.when(F.col("id") == 7, 1e12).otherwise((F.col("id") * 7919 % 20_000).cast("double")).alias("far"),
        F.when(F.col("id") % 2 == 0, 5.0).otherwise((F.col("id") % 1000).cast("double")).alias("half"),
        (F.col("id") % 3).cast("double").alias("few"), F.lit(4.0).alias("one"), F.when(F.col("id") == 3, 1e-9).when(F.col("id") == 4, 1.0).otherwise(0.0).alias("rare"))
    far, half, few, one, rare = C.thresholds(df, df.columns)
    assert len(far) == 31 and all(abs(c - 625 * (i + 1)) < 60 for i, c in enumerate(far))
    assert 10 < len(half) <= 31 and half == sorted(set(half)) and sum(c < 4 for c in half) <= 1
    assert few == [0.5, 1.5] and one == [] and rare == [5e-10, pytest.approx(0.5)]


def test_too_many_cells_or_categories_are_left_to_spark(data, monkeypatch):
    monkeypatch.setattr(M, "ROWS_AS_THEY_ARE", 0)
    assert C.fit(data, NAMES, "label", {0: 1.0, 1: 1.0}, RandomForestClassifier(), max_cells=10) is None
    monkeypatch.setattr(C, "fit", lambda *a, **b: None)
    assert M.train(data, "label", ["id"], SIZE, NAMES).nodes is None


def test_a_table_is_scored_by_cell_as_by_row(spark, data, by_cell, monkeypatch):
    """Nulls, NaN and infinite values; the forest scores each cell once; where cells are too many, each row is scored."""
    trained = M.train(data, "label", ["id"], SIZE, NAMES)
    odd = data.withColumn("x5", F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 9 == 1, float("nan")).when(
        F.col("id") % 9 == 2, float("inf")).when(F.col("id") % 9 == 3, -float("inf")).otherwise(F.col("x5")))
    odd = odd.union(odd.where("id < 50"))
    expected = sorted((r["id"], r["prediction"]) for r in trained.score(odd).collect())
    got = trained.score_table(odd)
    assert got.columns == [*odd.columns, "prediction"] and sorted((r["id"], r["prediction"]) for r in got.collect()) == expected
    assert trained.score_table(odd.where("id < 0")).count() == 0
    with pytest.raises(ValueError):
        trained.score_table(odd.drop("x5"))
    monkeypatch.setattr(M, "CELLS_SENT", 1)
    monkeypatch.setattr(M.Trained, "cell", lambda *a: pytest.fail("counted by cell"))
    assert sorted((r["id"], r["prediction"]) for r in trained.score_table(odd).collect()) == expected
