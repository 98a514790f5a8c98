"""Running totals and positions that never put a whole group into one task.

A plain ``Window.partitionBy(group).orderBy(value)`` sorts a group in one task. Here equal
values are first summed (map side and shuffle), then every group is cut into value blocks, each
block is handled on its own and a small table of block totals supplies what came before it.
The cut points steer only the balance of the blocks; results do not depend on them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE = 32                      # blocks per group = SIDE * SIDE
ROWS_PER_TASK = 1_000_000      # distinct values of one group that one task may sort


@dataclass(frozen=True)
class Cuts:
    """Cut points per group; none where the group is small enough for one block."""

    points: Mapping[str, Sequence[float]]

    @property
    def single_block(self) -> bool:
        return not any(self.points.values())


def find_cuts(df: DataFrame, columns: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> Cuts:
    """One scan with map-side sketches; at most SIDE*SIDE numbers per column reach the driver."""
    n = SIDE * SIDE
    shares = [i / n for i in range(1, n)]
    aggs = []
    for i, c in enumerate(columns):
        clean = F.nanvl(F.col(c).cast("double"), F.lit(None))
        aggs += [F.approx_count_distinct(clean).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    large = [c for i, c in enumerate(columns) if row[f"d{i}"] > rows_per_task]
    if not large:
        return Cuts({c: [] for c in columns})
    marks = df.agg(*[
        F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), shares, 10 * n).alias(f"p{i}")
        for i, c in enumerate(large)
    ]).first()
    return Cuts({c: sorted(set(marks[f"p{large.index(c)}"] or [])) if c in large else [] for c in columns})


def block_of(cuts: Cuts, group: Column, value: Column) -> Column:
    """Block number of a value: two short searches instead of one long one."""
    out = F.lit(0)
    for name, points in cuts.points.items():
        if not points:
            continue
        coarse = F.array(*[F.lit(float(p)) for p in points[SIDE - 1::SIDE]])
        every = F.array(*[F.lit(float(p)) for p in points])
        at = F.size(F.filter(coarse, lambda p: p < value))
        fine = F.size(F.filter(F.slice(every, at * SIDE + 1, SIDE), lambda p: p < value))
        out = F.when(group == name, at * SIDE + fine).otherwise(out)
    return out


def running_totals(counts: DataFrame, group: str, value: str, amounts: Sequence[str], cuts: Cuts) -> DataFrame:
    """Adds ``cum_<amount>`` in value order and ``all_<amount>`` per group.

    ``counts`` has one row per (group, value): equal values are summed before they get here.
    """
    if cuts.single_block:
        upto = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(group)
        return counts.select(
            "*",
            *[F.sum(a).over(upto).alias(f"cum_{a}") for a in amounts],
            *[F.sum(a).over(whole).alias(f"all_{a}") for a in amounts],
        )
    blocked = counts.withColumn("_block", block_of(cuts, F.col(group), F.col(value)))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    sums = blocked.groupBy(group, "_block").agg(*[F.sum(a).alias(f"_s_{a}") for a in amounts])
    offsets = sums.select(
        group, "_block",
        *[F.coalesce(F.sum(f"_s_{a}").over(before), F.lit(0)).alias(f"_b_{a}") for a in amounts],
        *[F.sum(f"_s_{a}").over(whole).alias(f"all_{a}") for a in amounts],
    )
    upto = Window.partitionBy(group, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select("*", *[F.sum(a).over(upto).alias(f"_c_{a}") for a in amounts])
    # offsets: at most SIDE*SIDE rows per group, and groups are table columns, so its size is known.
    joined = local.join(F.broadcast(offsets), [group, "_block"])
    return joined.select(
        *counts.columns,
        *[(F.col(f"_c_{a}") + F.col(f"_b_{a}")).alias(f"cum_{a}") for a in amounts],
        *[F.col(f"all_{a}") for a in amounts],
    )


def positions(df: DataFrame, order: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds ``position`` 0, 1, 2 ... by a numeric column without repeats, block by block."""
    cuts = Cuts({"all": find_cuts(df, [order], rows_per_task).points[order]})
    tagged = df.withColumns({"_group": F.lit("all"), "_one": F.lit(1).cast("bigint")})
    ranked = running_totals(tagged, "_group", order, ["_one"], cuts)
    return ranked.select(*df.columns, (F.col("cum__one") - 1).alias("position"))
