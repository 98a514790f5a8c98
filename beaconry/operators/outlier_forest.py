"""Isolation forest: constant-size fit on a hashed sample, map-only scoring of every row.

Follows the published method: a tree isolates a small sample by random cuts; rows that are
isolated early are anomalous. Score = 2 ** (-mean path length / c(sample size)).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions.histograms import exact_quantiles
from beaconry.session import stored

TREES, SAMPLE, CONTAMINATION = 100, 256, 0.05


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def _grow(values: np.ndarray, seed: int, max_depth: int) -> list[tuple]:
    """Nodes (id, feature, cut, left, right, path); leaves have feature -1."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    todo = [(0, values, 0)]
    next_id = 1
    while todo:
        node, rows, depth = todo.pop()
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else np.zeros(0, int)
        if depth >= max_depth or not len(spread):
            nodes.append((node, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        low = rows[:, f] < cut
        nodes.append((node, f, cut, next_id, next_id + 1, 0.0))
        todo += [(next_id, rows[low], depth + 1), (next_id + 1, rows[~low], depth + 1)]
        next_id += 2
    return nodes


def fit(df: DataFrame, features: Sequence[str], row_key: Sequence[str], trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Tree nodes as a table of at most trees * (2 * sample) rows, however large ``df`` is.

    The method grows each tree from ``sample`` rows only; that is its own subsample, not a cap on what is scored. The rows of
    smallest hash form it: a bound on the hash, set from the row count, leaves each task a handful, and of those the
    smallest are taken, the same on every run.
    """
    clean = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.xxhash64(*row_key).alias("_h"))
    for f in features:
        clean = clean.where(F.col(f).isNotNull() & ~F.isnan(f))
    n = clean.count()
    if n > 2 * trees * sample:  # the hash is uniform: twice as many as needed pass the bound
        clean = clean.where(F.col("_h") < int(-(2**63) + 2**64 * (2 * trees * sample / n)))
    picked = clean.orderBy("_h", *features).limit(trees * sample)  # 25,600 rows by default
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_h", *features))
    dealt = picked.withColumn("tree_id", (place % trees).cast("int"))
    depth = math.ceil(math.log2(max(sample, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree_id"].iloc[0])
        ordered = pdf.sort_values(["_h", *features])
        out = pd.DataFrame(_grow(ordered[list(features)].to_numpy(), tree, depth),
                           columns=["node", "feature", "cut", "left", "right", "path"])
        out.insert(0, "tree_id", tree)
        out["sample_size"] = len(pdf)
        return out

    return dealt.groupBy("tree_id").applyInPandas(
        grow, "tree_id int, node int, feature int, cut double, left int, right int, path double, sample_size int")


def score(df: DataFrame, features: Sequence[str], nodes: DataFrame) -> DataFrame:
    """Adds ``anomaly_score``; rows with a missing feature get none. The model is a small constant table."""
    table = nodes.toPandas()
    forest = []
    for _, g in table.groupby("tree_id"):
        g = g.sort_values("node")
        forest.append(tuple(g[c].to_numpy() for c in ("feature", "cut", "left", "right", "path")))
    norm = float(average_path(float(table.groupby("tree_id")["sample_size"].first().mean()))) or 1.0
    names = list(features)

    def path_lengths(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, path in forest:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                here = at[inner]
                below = x[inner, feature[here]] < cut[here]
                at[inner] = np.where(below, left[here], right[here])
            total += path[at]
        return total / len(forest)

    lookup = None
    if len(names) == 1 and forest:
        # one feature: the mean path length is a step function of it, with steps at the cuts
        steps = np.unique(np.concatenate([cut[feature >= 0] for feature, cut, *_ in forest]))
        lookup = steps, path_lengths(np.concatenate([[-np.inf], steps])[:, None])

    def mean_paths(x: np.ndarray) -> np.ndarray:
        if lookup is None:
            return path_lengths(x)
        steps, lengths = lookup
        return lengths[np.searchsorted(steps, x[:, 0], side="right")]

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in parts:
            x = pdf[names].to_numpy(dtype=float)
            ok = ~np.isnan(x).any(axis=1)
            out = np.full(len(x), np.nan)
            out[ok] = np.power(2.0, -mean_paths(x[ok]) / norm)
            yield pd.Series(out)

    value = scored(F.struct(*[F.col(f).cast("double").alias(f) for f in names]))
    return df.withColumn("anomaly_score", F.nanvl(value, F.lit(None)))


def detect(
    df: DataFrame, features: Sequence[str], row_key: Sequence[str], contamination: float = CONTAMINATION,
    trees: int = TREES, sample: int = SAMPLE,
) -> DataFrame:
    """Rows whose score lies above the exact (1 - contamination) quantile of all scores."""
    scored = stored(score(df, features, fit(df, features, row_key, trees, sample)), "scores")
    limit = exact_quantiles(scored, ["anomaly_score"], {"limit": 1 - contamination})
    return scored.where(F.col("anomaly_score") > limit.get("anomaly_score", {"limit": 1.0})["limit"])
