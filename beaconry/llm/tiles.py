"""Comparing all members of a group in bounded tiles, and helpers for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(
    members: DataFrame, keys: list[str], row: str, block: int, weight: str | None = None, heaviest: int = 0
) -> DataFrame:
    """Add (tile_a, tile_b, block): groups of at most ``block`` rows get one tile, larger ones a tile for each pair of blocks.

    A tile holds the rows of two blocks (or of one), so no task ever holds a group that grew with the data. With a
    ``weight`` column (the size of a row), blocks hold about ``heaviest`` of it at most as well.
    Group sizes are counted before the shuffle and joined to the rows.
    """
    blocks = F.ceil(F.count("*") / block)
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.sum(weight) / heaviest))
    sizes = members.groupBy(*keys).agg(blocks.cast("int").alias("_blocks")).where("_blocks > 1")
    out = members.join(sizes, keys, "left").withColumn(
        "block", F.when(F.col("_blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64(row), F.col("_blocks"))).cast("int"))
    out = out.withColumn("_other", F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("_blocks") - 1))))
    return out.withColumn("tile_a", F.least("block", "_other")).withColumn(
        "tile_b", F.greatest("block", "_other")).drop("_blocks", "_other")


def by_group(
    df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Run ``work`` on the rows of each key, given as an Arrow table.

    Rows are shuffled and sorted by key; groups are cut from the stream of batches, so that many tiny groups
    cost little. ``work`` must be fit to hold one group (see tiled).
    """
    n_keys = len(keys)  # keys are numbers without nulls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in cols)
            change[0] = last is not None and first != last
            last = tuple(c[-1] for c in cols)
            start = 0
            for cut in np.flatnonzero(change):
                if cut > start:
                    held.append(batch.slice(start, cut - start))
                if held:
                    out = work(pa.Table.from_batches(held))
                    if out is not None:
                        yield out
                held, start = [], int(cut)
            held.append(batch.slice(start))
        if held:
            out = work(pa.Table.from_batches(held))
            if out is not None:
                yield out

    others = [c for c in df.columns if c not in keys]
    return df.select(*keys, *others).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def tile_labels(linked: np.ndarray) -> np.ndarray:
    """Component label (smallest index) of each row of a symmetric boolean matrix; rows link with themselves."""
    n = len(linked)
    label = np.arange(n)
    has = linked.copy()
    np.fill_diagonal(has, True)
    while True:
        low = np.where(has, label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low
