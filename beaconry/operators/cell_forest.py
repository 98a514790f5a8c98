"""Random forest of a large table, grown from counts of rows by cell.

A forest splits a feature at a few thresholds only (one less than ``BINS``), so all rows between the same thresholds take the same way
through every tree. Such a cell is one entry with a count for each class, however many rows lie in it: the rows are read once to be
counted, and growing costs no more when they become more. All rows count, with their class weights.

The method is that of Spark's RandomForestClassifier: thresholds at equal shares of the rows, each tree on a bootstrap of the rows (a row
is drawn by Poisson(1) times, so n rows of a cell and class are drawn by Poisson(n) times in all), the square root of the number of
features tried at each node, the largest fall of the Gini impurity, sides of ``min_leaf`` drawn rows at least, sibling leaves of one class
joined. Draws depend on the seed, the tree and the counts, not on how rows lie in partitions. The result is Spark's own model: nodes are
written in its format and loaded.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.functions.histograms import Span, long_values, ranges, with_bin
from beaconry.session import work_path

# Fixed value: intervals of a feature, as many as Spark's forest has.
BINS = 32
#: A histogram's bin of more than this share of the rows is zoomed into before thresholds are set.
FINE = 1 / 512
#: Cells there may be at most; they are held by the driver and by each task.
MAX_CELLS = 1 << 21
_NODES = ("tree int, id int, prediction double, impurity double, stats array<double>, rows bigint, gain double, "
          "low int, high int, feature int, cut array<double>")


def cuts_below(value: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """How many of the rising ``cuts`` lie below the value, plus ``first``: a search by halves."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(value <= cuts[half], cuts_below(value, cuts[:half], first)).otherwise(
        cuts_below(value, cuts[half + 1:], first + half + 1))


def thresholds(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Per column at most ``bins`` - 1 rising cuts, between all values where they are so few, else at about equal shares of the rows.

    All rows are counted, in histograms whose bins are zoomed into until each holds one value, or at most FINE of the rows where there
    are more of them than cuts are asked for.
    """
    whole = ranges(df, columns)
    settled: dict[str, list[tuple[float, float, int]]] = {c: [] for c in columns}
    spans = list(whole.values())
    while spans:
        found = with_bin(long_values(df, spans), spans).groupBy("span", "bin").agg(
            F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()  # bounded by bins and spans
        entries = {c: len(settled[c]) + sum(spans[r["span"]].column == c for r in found) for c in whole}
        wide = []
        for r in found:
            c = spans[r["span"]].column
            if r["a"] < r["b"] and (r["n"] > FINE * whole[c].rows or entries[c] <= bins):
                wide.append(Span(c, r["a"], r["b"], 0, r["n"]))
            else:
                settled[c].append((r["a"], r["b"], r["n"]))
        spans = wide
    return [_spaced(sorted(settled[c]), bins) for c in columns]


def _spaced(held: list[tuple[float, float, int]], bins: int) -> list[float]:
    """Cuts between neighbours of (smallest value, largest value, rows)."""
    def between(i: int) -> float:
        low, high = held[i][1], held[i + 1][0]
        middle = low + (high - low) / 2
        return middle if low <= middle < high else low

    if len(held) <= bins:
        return [between(i) for i in range(len(held) - 1)]
    stride = sum(n for *_, n in held) / bins
    out, below, target = [], held[0][2], stride
    for i in range(1, len(held)):
        if abs(below - target) < abs(below + held[i][2] - target) and len(out) < bins - 1:
            out.append(between(i - 1))
            target += stride
        below += held[i][2]
    return out


def _gini(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Impurity and sum of class weights (first axis: the class)."""
    total = weights.sum(axis=0)
    share = np.divide(weights, total, out=np.zeros_like(weights), where=total > 0)
    return np.where(total > 0, 1.0 - (share * share).sum(axis=0), 0.0), total


class Tree:
    """One tree, level by level; nodes of a level lie side by side, the children of a node in the next level."""

    def __init__(self, places: np.ndarray, drawn: np.ndarray, weight: np.ndarray, bins: int, tried: int, depth: int, min_leaf: int,
                 rng: np.random.Generator) -> None:
        self.levels: list[dict[str, np.ndarray]] = []
        self.weight, self.bins, self.min_leaf = weight, bins, min_leaf
        self.features = places.shape[1]
        used = np.flatnonzero(drawn.sum(axis=0) > 0)
        flat, drawn, at = np.ascontiguousarray(places[used]).ravel(), drawn[:, used], np.zeros(len(used), np.int64)
        cell = np.arange(len(used)) * self.features
        counts = drawn.sum(axis=1)[:, None]
        for level in range(depth + 1):
            n = counts.shape[1]
            stats = counts * weight[:, None]
            impurity, _ = _gini(stats)
            here = {"stats": stats, "rows": counts.sum(axis=0), "impurity": impurity, "gain": np.full(n, -1.0),
                    "feature": np.full(n, -1, np.int64), "bin": np.zeros(n, np.int64), "child": np.full(n, -1, np.int64)}
            self.levels.append(here)
            open_ = np.flatnonzero(impurity > 1e-12)
            if level == depth or not len(open_):
                break
            number = np.full(n, -1, np.int64)
            number[open_] = np.arange(len(open_))
            at = number[at]
            keep = at >= 0
            at, cell, drawn = at[keep], cell[keep], drawn[:, keep]
            ways = np.argsort(rng.random((len(open_), self.features)), axis=1)[:, :tried]
            gain, feature, place, left = self._best(flat, cell, at, drawn, ways, counts[:, open_])
            split = np.flatnonzero(gain > 0)
            if not len(split):
                break
            nodes = open_[split]
            here["gain"][nodes], here["feature"][nodes], here["bin"][nodes] = gain[split], feature[split], place[split]
            here["child"][nodes] = 2 * np.arange(len(split))
            counts = np.stack([left[:, split], counts[:, nodes] - left[:, split]], axis=2).reshape(len(weight), -1)
            number = np.full(len(open_), -1, np.int64)
            number[split] = np.arange(len(split))
            keep = number[at] >= 0
            at, cell, drawn = at[keep], cell[keep], drawn[:, keep]
            right = flat[cell + feature[at]] > place[at]
            at = 2 * number[at] + right

    def _best(self, flat: np.ndarray, cell: np.ndarray, at: np.ndarray, drawn: np.ndarray, ways: np.ndarray,
              counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every node the best gain, its feature, the last bin of the lower side and the counts of that side."""
        n = counts.shape[1]
        gain, feature, place = np.zeros(n), np.full(n, -1, np.int64), np.zeros(n, np.int64)
        left = np.zeros_like(counts)
        node = np.arange(n)
        impurity, weight = _gini(counts * self.weight[:, None])
        rows = counts.sum(axis=0)
        for way in ways.T:
            key = at * self.bins + flat[cell + way[at]]
            low = np.stack([np.bincount(key, d, n * self.bins).reshape(n, self.bins).cumsum(axis=1) for d in drawn])
            low_rows = low.sum(axis=0)
            fits = (low_rows >= self.min_leaf) & (rows[:, None] - low_rows >= self.min_leaf)
            i, j = np.nonzero(fits)  # only these are weighed: of small nodes they are few
            below = low[:, i, j]
            (a, a_weight), (b, b_weight) = _gini(below * self.weight[:, None]), _gini((counts[:, i] - below) * self.weight[:, None])
            fall = np.full(fits.shape, -1.0)
            fall[i, j] = impurity[i] - a_weight / weight[i] * a - b_weight / weight[i] * b
            best = fall.argmax(axis=1)
            better = np.flatnonzero(fall[node, best] > gain)
            gain[better], feature[better], place[better] = fall[better, best[better]], way[better], best[better]
            left[:, better] = low[:, better, best[better]]
        return gain, feature, place, left

    def rows(self, tree: int, cuts: list[list[float]]) -> pa.RecordBatch:
        """The nodes as Spark numbers them: a node, all below its lower side, all below its upper side."""
        below: dict[str, np.ndarray] | None = None
        for x in reversed(self.levels):  # sibling leaves of one class are one leaf
            x["prediction"] = x["stats"].argmax(axis=0)
            x["size"] = np.ones(len(x["rows"]), np.int64)
            inner = np.flatnonzero(x["child"] >= 0)
            if len(inner):
                a, b = x["child"][inner], x["child"][inner] + 1
                joined = (below["child"][a] < 0) & (below["child"][b] < 0) & (below["prediction"][a] == below["prediction"][b])
                for name in ("child", "feature", "gain"):
                    x[name][inner[joined]] = -1
                inner, a, b = inner[~joined], a[~joined], b[~joined]
                x["size"][inner] += below["size"][a] + below["size"][b]
            below = x
        out: dict[str, list[np.ndarray]] = {}
        stay, number = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level, x in enumerate(self.levels):
            child, inner = x["child"][stay], x["child"][stay] >= 0
            after = self.levels[level + 1]["size"] if inner.any() else np.zeros(1, np.int64)
            low = np.where(inner, number + 1, -1)
            high = np.where(inner, number + 1 + after[np.where(inner, child, 0)], -1)
            for name, value in {
                    "id": number, "prediction": x["prediction"][stay].astype(float), "impurity": x["impurity"][stay],
                    "stats": x["stats"][:, stay].T, "rows": x["rows"][stay].astype(np.int64), "gain": x["gain"][stay], "low": low,
                    "high": high, "feature": x["feature"][stay], "bin": x["bin"][stay]}.items():
                out.setdefault(name, []).append(value)
            stay = np.stack([child[inner], child[inner] + 1], axis=1).ravel()
            number = np.stack([low[inner], high[inner]], axis=1).ravel()
            if not len(stay):
                break
        made = {name: np.concatenate(value) for name, value in out.items()}
        n = len(made["id"])
        inner = made["feature"] >= 0
        cut = np.array([cuts[f][b] for f, b in zip(made["feature"][inner], made["bin"][inner], strict=True)])
        stats = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * made["stats"].shape[1]), pa.array(made["stats"].ravel()))
        ends = np.concatenate([[0], np.cumsum(inner)]).astype(np.int32)
        return pa.record_batch({
            "tree": pa.array(np.full(n, tree, np.int32)), "id": pa.array(made["id"].astype(np.int32)), "prediction": made["prediction"],
            "impurity": made["impurity"], "stats": stats, "rows": made["rows"], "gain": made["gain"],
            **{c: pa.array(made[c].astype(np.int32)) for c in ("low", "high", "feature")},
            "cut": pa.ListArray.from_arrays(pa.array(ends), pa.array(cut, pa.float64()))})


def fit(df: DataFrame, columns: Sequence[str], label: str, weights: dict[int, float], estimator: RandomForestClassifier,
        bins: int = BINS, max_cells: int = MAX_CELLS) -> tuple[RandomForestClassificationModel, str] | None:
    """The forest on finite number ``columns`` and the classes of ``label``, and where it lies; None where there may be more than
    ``max_cells`` cells.

    Trees, depth, leaf size, seed and column names are those of ``estimator``; rows weigh by their class.
    """
    spark = df.sparkSession
    cuts = thresholds(df, columns, bins)
    if math.prod(len(c) + 1 for c in cuts) > max_cells:
        return None
    cell = F.lit(0).cast("bigint")
    for c, values in zip(columns, cuts, strict=True):
        cell = cell * (len(values) + 1) + cuts_below(F.col(c), values)
    counted = df.groupBy(cell.alias("cell"), F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n")).toArrow()
    classes = max(2, 1 + max(int(v) for v in weights))
    cells, at = np.unique(counted.column("cell").to_numpy(), return_inverse=True)
    n = np.zeros((classes, len(cells)))
    n[counted.column("label").to_numpy(), at] = counted.column("n").to_numpy()
    places = np.stack(np.unravel_index(cells, [len(c) + 1 for c in cuts]), axis=1).astype(np.uint8)
    weight = np.array([float(weights.get(c, 1.0)) for c in range(classes)])
    trees, depth, seed = estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed()
    min_leaf, tried = estimator.getMinInstancesPerNode(), math.ceil(math.sqrt(len(columns))) if trees > 1 else len(columns)
    shared = spark.sparkContext.broadcast((places, n, weight, cuts))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, n, weight, cuts = shared.value
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed & (2**63 - 1), tree])
                drawn = rng.poisson(n).astype(float)
                yield Tree(places, drawn, weight, bins, tried, depth, min_leaf, rng).rows(tree, cuts)

    cores = spark.sparkContext.defaultParallelism
    nodes = spark.range(0, trees, 1, min(trees, 4 * cores)).mapInArrow(grow, _NODES)
    path = work_path(spark, "forest")
    _write(spark, nodes, estimator, len(columns), classes, path)
    return RandomForestClassificationModel.load(path), path


def _write(spark: SparkSession, nodes: DataFrame, estimator: RandomForestClassifier, features: int, classes: int, path: str) -> None:
    """A forest as Spark saves it: its parameters, those of the trees, and one row for each node."""
    split = F.struct(F.col("feature").alias("featureIndex"), F.col("cut").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    nodes.select(F.col("tree").alias("treeID"), F.struct(
        "id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("rows").alias("rawCount"), "gain",
        F.col("low").alias("leftChild"), F.col("high").alias("rightChild"), split.alias("split")).alias("nodeData")).write.parquet(f"{path}/data")
    estimator.write().overwrite().save(f"{path}/estimator")
    facts = json.loads(spark.read.text(f"{path}/estimator/metadata").first()[0])
    trees = estimator.getNumTrees()
    name = "org.apache.spark.ml.classification."
    whole = facts | {"class": f"{name}RandomForestClassificationModel", "numFeatures": features, "numClasses": classes, "numTrees": trees}
    own = {"bootstrap", "featureSubsetStrategy", "numTrees", "subsamplingRate"}  # a single tree has none of these
    one = facts | {"class": f"{name}DecisionTreeClassificationModel", "uid": "dtc_0"} | {
        k: {p: v for p, v in facts[k].items() if p not in own} for k in ("paramMap", "defaultParamMap")}
    spark.range(1, numPartitions=1).select(F.lit(json.dumps(whole)).alias("value")).write.text(f"{path}/metadata")
    spark.range(0, trees, 1, 1).select(
        F.col("id").cast("int").alias("_1"), F.replace(F.lit(json.dumps(one)), F.lit('"dtc_0"'), F.concat(
            F.lit('"dtc_'), F.col("id").cast("string"), F.lit('"'))).alias("_2"), F.lit(1.0).alias("_3")).write.parquet(f"{path}/treesMetadata")
