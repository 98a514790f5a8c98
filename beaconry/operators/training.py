"""Feature preparation, forest training behind a quality gate, and batch scoring.

Imputing, scaling and clipping are a stage of the fitted pipeline, so a saved model scores after loading exactly
as it did before.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconry.functions.histograms import exact_quantiles
from beaconry.functions.scalars import FINITE_LIMIT
from beaconry.operators import cell_forest, scorecard
from beaconry.operators.cell_forest import cuts_below
from beaconry.operators.profile import numeric_columns
from beaconry.session import stored, work_path
from beaconry.settings import DEFAULTS
from beaconry.sources import sinks

# Share of training rows, forest size, leaf size and seed. Depth is Spark's maximum.
TRAIN_SHARE, TREES, MIN_LEAF, MAX_DEPTH, SEED = 0.8, 200, 5, 30, 42
SPLIT_DIGITS = 4
#: Training rows of one task of the forest: the split's files are few and small, the work on a row is not.
ROWS_PER_TASK = 30_000
#: Up to so many training rows Spark's forest passes over the rows; more are counted by cell first.
ROWS_AS_THEY_ARE = 100_000
#: Up to so many possible cells the table of their classes is sent to the tasks (about 32 bytes each).
CELLS_SENT = 1 << 20


@dataclass(frozen=True)
class ForestSize:
    trees: int = TREES
    depth: int = MAX_DEPTH
    min_leaf: int = MIN_LEAF
    seed: int = SEED


class QualityGateError(RuntimeError):
    """The new model is not accurate enough; nothing was saved."""


def feature_columns(df: DataFrame, label: str) -> list[str]:
    """Numeric columns except the label."""
    return [c for c in numeric_columns(df) if c != label]


def medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact median per feature: one number per column reaches the driver."""
    return {c: q["median"] for c, q in exact_quantiles(df, features, {"median": 0.5}).items()}


def impute(df: DataFrame, fitted: dict[str, float]) -> DataFrame:
    """Fill null and NaN by the medians fitted on the training rows."""
    return df.withColumns({
        c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)) for c, m in fitted.items()})


def stratified_split(df: DataFrame, label: str, key: Sequence[str], share: float = TRAIN_SHARE) -> DataFrame:
    """Adds ``in_train``: an exact share of every class, by a fixed hash of the row; rows of equal key fall on the same side.

    Hashes are uniform, so their first digits cut a class into many small ranges. Counts per range tell in which one the share
    ends, and only the rows of that range are ranked, for the last hash that belongs to it. Rows are not shuffled: they meet
    one row per class.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in key])
    tagged = df.withColumn("_h", F.md5(text.cast("binary"))).withColumn("_b", F.substring("_h", 1, SPLIT_DIGITS))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = tagged.groupBy(label, "_b").agg(F.count("*").alias("_n")).select(
        label, "_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(label)).alias("_all"))
    quota = F.col("_all") - F.ceil(F.col("_all") * (1 - share))
    ends = sizes.where((F.col("_before") < quota) & (F.col("_before") + F.col("_n") >= quota)).select(
        label, "_b", (quota - F.col("_before")).alias("_take"))
    place = F.row_number().over(Window.partitionBy(label).orderBy("_h"))
    last = tagged.select(label, "_b", "_h").join(ends, [label, "_b"]).withColumn("_r", place).where(
        F.col("_r") == F.col("_take")).select(label, F.col("_h").alias("_last"))
    classes = sizes.select(label).distinct().join(last, label, "left")  # a class too small for the share has no last row
    return tagged.join(classes, label).select(*df.columns, F.coalesce(F.col("_h") <= F.col("_last"), F.lit(False)).alias("in_train"))


@dataclass(frozen=True)
class Derived:
    """Features made from columns: log(1 + x) of ``logs``, sine and cosine of ``cycles`` (column, period), one-hot ``categories``."""

    logs: tuple[str, ...] = ()
    cycles: tuple[tuple[str, float], ...] = ()
    categories: tuple[str, ...] = ()

    @property
    def sources(self) -> list[str]:
        return list(dict.fromkeys([*self.logs, *(c for c, _ in self.cycles), *self.categories]))

    @property
    def numeric(self) -> list[str]:
        turns = [f"_{w}{i}" for i in range(len(self.cycles)) for w in ("sin", "cos")]
        return [*(f"_log{i}" for i in range(len(self.logs))), *turns]

    def transformer(self) -> SQLTransformer:
        """Adds the numeric ones; negative values count as 0 in logarithms."""
        parts = [f"ln(1 + greatest(cast(`{c}` AS double), double('0'))) AS _log{i}" for i, c in enumerate(self.logs)]
        parts += [f"{w}(2 * pi() * cast(`{c}` AS double) / double('{period!r}')) AS _{w}{i}"
                  for i, (c, period) in enumerate(self.cycles) for w in ("sin", "cos")]
        return SQLTransformer(statement=f"SELECT {', '.join(['*', *parts])} FROM __THIS__")

    def encoders(self) -> list:
        """Classes by falling frequency; a class not seen in training, or null, has a place of its own."""
        if not self.categories:
            return []
        n = range(len(self.categories))
        index, hot = [f"_class{i}" for i in n], [f"_hot{i}" for i in n]
        return [StringIndexer(inputCols=list(self.categories), outputCols=index, handleInvalid="keep"),
                OneHotEncoder(inputCols=index, outputCols=hot, dropLast=False)]

    @property
    def vectors(self) -> list[str]:
        return [f"_hot{i}" for i in range(len(self.categories))]


def scaling(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature; two numbers per column reach the driver."""
    row = df.agg(*[x for i, c in enumerate(features) for x in (
        F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(features)}


def standardise(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """Zero mean and unit deviation; a constant column becomes 0."""
    return df.withColumns({c: (F.col(c) - m) / (s or 1.0) for c, (m, s) in fitted.items()})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c) per class; one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # a handful of classes
    return counts.select(label, "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """The table in as many partitions as its number of rows asks for, whatever the files it lies in."""
    return df.repartition(max(1, -(-rows // ROWS_PER_TASK)))


def by_cell(cells: DataFrame, name: str) -> DataFrame:
    """Cells dealt out to all cores and, there, in order: near ones take the same ways through the trees, which is faster."""
    return cells.repartition(cells.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions(name)


def preparation(fitted: dict[str, float], scaled: dict[str, tuple[float, float]]) -> SQLTransformer:
    """Impute, scale and clip as one pipeline stage; the input columns stay as they are."""
    parts = []
    for i, (c, median) in enumerate(fitted.items()):
        mean, deviation = scaled[c]
        filled = f"coalesce(nanvl(cast(`{c}` AS double), null), double('{median!r}'))"
        parts.append(f"({filled} - double('{mean!r}')) / double('{(deviation or 1.0)!r}') AS _z{i}")
    names = ", ".join(f"CASE WHEN _z{i} IS NULL OR isnan(_z{i}) OR abs(_z{i}) = double('Infinity') THEN {FINITE_LIMIT!r}D "
                      f"ELSE _z{i} END AS _f{i}" for i in range(len(parts)))
    return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(f'_z{i}' for i in range(len(parts)))}), {names} "
                                    f"FROM (SELECT *, {', '.join(parts)} FROM __THIS__)")


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    features: tuple[str, ...]
    medians: dict[str, float]
    scaling: dict[str, tuple[float, float]]
    card: dict
    derived: Derived = Derived()
    saved: str | None = None  # where the pipeline was saved, if it was
    nodes: str | None = None  # where the forest alone was written, if it was

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``; a missing feature column is an error."""
        scorecard.require_columns(df, *dict.fromkeys([*self.features, *self.derived.sources]))
        return self.model.transform(df).select(*df.columns, F.col("prediction").cast("int").alias("prediction"))

    @cached_property
    def cuts(self) -> dict[int, list[float] | None]:
        """Per feature that the forest splits by: its thresholds in rising order (fewer than the forest's bins), None for classes.

        They are read by Spark from the table of nodes that the forest is saved as; a saved model is not saved again.
        """
        spark, forest = SparkSession.active(), self.model.stages[-1]
        if self.saved or self.nodes:
            path = f"{self.saved}/stages/*_{forest.uid}" if self.saved else self.nodes
        else:
            path = work_path(spark, "forest")
            forest.write().save(path)
        found = spark.read.parquet(f"{path}/data").select("nodeData.split.*").where("featureIndex >= 0").groupBy("featureIndex").agg(
            F.max("numCategories").alias("classes"),
            F.sort_array(F.collect_set(F.when(F.col("numCategories") < 0, F.col("leftCategoriesOrThreshold")[0]))).alias("cuts"))
        return {r["featureIndex"]: None if r["classes"] >= 0 else r["cuts"] for r in found.collect()}  # one row per feature

    def cell(self, df: DataFrame, name: str) -> DataFrame:
        """Adds ``name``: the cell of a record between the forest's thresholds, per feature the number of thresholds below its value
        (a class as it is). Every split sends all records of a cell the same way, so they get the same class."""
        scorecard.require_columns(df, *dict.fromkeys([*self.features, *self.derived.sources]))
        places = [F.get("_x", F.lit(i)).cast("int") if cuts is None else cuts_below(F.get("_x", F.lit(i)), cuts)
                  for i, cuts in sorted(self.cuts.items())]
        prepared = PipelineModel(self.model.stages[:-1]).transform(df).select(*df.columns, vector_to_array("_features").alias("_x"))
        return prepared.select(*df.columns, F.array(*places).cast("array<int>").alias(name))

    def class_of(self, cells: DataFrame, cell: str, name: str) -> DataFrame:
        """Adds ``name``: the class of the records in a cell, scored by the forest at the cell's upper corner."""
        def corner(at: int, cuts: list[float] | None) -> Column:
            place = F.get(F.col(cell), F.lit(at))
            return place.cast("double") if cuts is None else F.get(F.array(*[F.lit(c) for c in [*cuts, float("inf")]]), place)

        order = {i: (at, cuts) for at, (i, cuts) in enumerate(sorted(self.cuts.items()))}
        forest = self.model.stages[-1]
        x = [corner(*order[i]) if i in order else F.lit(0.0) for i in range(forest.numFeatures)]
        return forest.transform(cells.withColumn("_features", array_to_vector(F.array(*x)))).select(
            *cells.columns, F.col("prediction").cast("int").alias(name))

    def score_cells(self, cells: DataFrame, name: str) -> DataFrame:
        """One row per distinct cell: ``name`` and ``prediction``."""
        return self.class_of(by_cell(cells.select(name).distinct(), name), name, "prediction")

    def score_table(self, df: DataFrame) -> DataFrame:
        """``score`` for a large table: the forest scores each cell once, and a row looks up the class of its cell.

        Where cells may be more than CELLS_SENT, or features are categories, each row is scored by itself.
        """
        cuts = [c for _, c in sorted(self.cuts.items())]
        if any(c is None for c in cuts) or math.prod(len(c) + 1 for c in cuts) > CELLS_SENT:
            return self.score(df)

        def numbered(cells: DataFrame) -> DataFrame:
            number = F.lit(0).cast("bigint")
            for i, c in enumerate(cuts):
                number = number * (len(c) + 1) + F.get("_cell", F.lit(i))
            return cells.withColumn("_cell", number)

        celled = self.cell(df, "_cell")
        classes = numbered(self.score_cells(celled, "_cell"))  # bounded by the forest's thresholds
        return numbered(celled).join(F.broadcast(classes), "_cell").select(*df.columns, "prediction")

    def facts(self) -> dict:
        """What is saved beside the pipeline."""
        return {"features": list(self.features), "medians": self.medians, "scaling": self.scaling, "card": self.card,
                "derived": [self.derived.logs, self.derived.cycles, self.derived.categories]}


def load(spark: SparkSession, folder: str) -> Trained:
    """The model that the pointer of ``folder`` names."""
    return load_artefact(spark, sinks.current_model_path(spark, folder))


def load_artefact(spark: SparkSession, path: str) -> Trained:
    """The model saved at ``path``, whether or not it was published."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    logs, cycles, categories = facts.get("derived", [[], [], []])
    return Trained(PipelineModel.load(f"{path}/pipeline"), tuple(facts["features"]), facts["medians"],
                   {c: tuple(v) for c, v in facts["scaling"].items()}, facts["card"],
                   Derived(tuple(logs), tuple((c, p) for c, p in cycles), tuple(categories)), f"{path}/pipeline")


def train(
    df: DataFrame, label: str, key: Sequence[str], size: ForestSize = ForestSize(), features: Sequence[str] | None = None,
    derived: Derived = Derived(),
) -> Trained:
    """Split, fit medians and scaling on the training rows only, weight the classes, fit the forest.

    ``key`` names the columns the split is hashed by; ``features`` defaults to every numeric column. The split is
    written once, since medians, scaling, weights, the fit and the held-out score all read it. A large table is counted by cell
    (see ``cell_forest``). Where that is not to be done (few rows, categories, more cells than a task holds), Spark's forest passes over
    the rows and remembers the node of every row and tree, so that a level does not walk all rows down from the roots again;
    recomputing the nodes of a lost executor takes at most as many steps as the trees are deep.
    """
    features = list(features) if features else feature_columns(df, label)
    split = stored(stratified_split(df.select(*dict.fromkeys([*key, *features, *derived.sources, label])), label, key), "split")
    learn, held = split.where("in_train"), split.where("not in_train")
    every = [*features, *derived.numeric]
    made = derived.transformer().transform(learn)
    fitted = medians(made, every)
    scaled = scaling(impute(made, fitted), every)
    classes = class_weights(learn, label).collect()  # one row per class
    weights, rows = {r[label]: r["weight"] for r in classes}, sum(r["n"] for r in classes)
    weight = F.lit(1.0)
    for value, w in weights.items():
        weight = F.when(F.col(label) == value, w).otherwise(weight)
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="_features", weightCol="_weight", numTrees=size.trees, maxDepth=size.depth,
        minInstancesPerNode=size.min_leaf, seed=size.seed, cacheNodeIds=True, checkpointInterval=-1)
    numbers = [f"_f{i}" for i in range(len(every))]
    steps = [derived.transformer(), preparation(fitted, scaled), *derived.encoders(),
             VectorAssembler(inputCols=[*numbers, *derived.vectors], outputCol="_features")]
    grown = nodes = None
    if rows > ROWS_AS_THEY_ARE and not derived.categories and all(v == int(v) and v >= 0 for v in weights):
        grown, nodes = cell_forest.fit(PipelineModel(steps[:2]).transform(learn), numbers, label, weights, forest) or (None, None)
    model = PipelineModel([*steps, grown]) if grown else Pipeline(stages=[*steps, forest]).fit(
        dealt(learn.withColumn("_weight", weight), rows))
    trained = Trained(model, tuple(features), fitted, scaled, {}, derived, nodes=nodes)
    cores = df.sparkSession.sparkContext.defaultParallelism  # scoring is heavy per row, the split's files are few
    scored = trained.score_table(held) if grown else trained.score(held.repartition(cores))
    judged = scored.select(F.col(label).alias("actual"), "prediction")
    return replace(trained, card=scorecard.scorecard(judged).first().asDict())


def train_and_publish(
    df: DataFrame, label: str, key: Sequence[str], folder: str, version: str,
    threshold: float = DEFAULTS.accuracy_threshold, size: ForestSize = ForestSize(),
    features: Sequence[str] | None = None, derived: Derived = Derived(),
) -> Trained:
    """Train, and publish only if the held-out accuracy reaches the threshold and the saved artefact, loaded again, holds trees and
    scores a known record; else the old model stays. The returned model knows where it was saved."""
    trained = train(df, label, key, size, features, derived)
    if trained.card["accuracy"] < threshold:
        raise QualityGateError(f"accuracy {trained.card['accuracy']:.4f} is under {threshold:.4f}")

    def check(path: str) -> None:
        saved = load_artefact(df.sparkSession, path)
        if not saved.model.stages[-1].totalNumNodes:  # one number: listing the trees here wraps every one of them in Python
            raise QualityGateError("the saved model is empty")
        if not smoke_test(saved, df):
            raise QualityGateError("the saved model does not score a known record")

    path = sinks.publish_model(df.sparkSession, trained.model, trained.facts(), folder, version, check)
    return replace(trained, saved=f"{path}/pipeline")


def batch_score(trained: Trained, records: DataFrame, version: str, scored_at: str) -> DataFrame:
    """Predictions keyed by the record's own columns; an empty batch is refused."""
    if records.isEmpty():
        raise ValueError("the batch holds no records")
    name = version.rsplit(".", 1)[0] if "." in version.rsplit("/", 1)[-1] else version
    return trained.score_table(records).withColumns({
        "model_version": F.lit(name.replace("/", "_")), "scored_at": F.lit(scored_at)})


def smoke_test(trained: Trained, record: DataFrame) -> bool:
    """One known record must score to a known class."""
    row = trained.score(record.limit(1)).first()
    return row is not None and row["prediction"] in (0, 1)
