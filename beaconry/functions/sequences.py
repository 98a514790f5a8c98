"""Previous-row lookups and joins that stay balanced when one key holds much of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_row(
    df: DataFrame, keys: Sequence[str], order: str, block: Column, values: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """``lag`` over (keys, order) computed block by block.

    ``block`` is a number that never falls as ``order`` rises (day number, turn div 10000 ...).
    Inside a block a plain ``lag`` works; the first row of a block takes the last row of the block
    before, found over one summary row per block. A hot key is thus spread over its blocks.
    """
    keys = list(keys)
    tagged = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    row = F.struct(*[F.col(v) for v in values])
    local = tagged.select("*", F.lag(row).over(inside).alias("_near"))
    ends = tagged.groupBy(*keys, "_block").agg(F.max_by(row, F.col(order)).alias("_last"))
    carried = ends.select(
        *keys, "_block", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_far")
    )
    joined = local.join(carried, [*keys, "_block"], "left")
    chosen = F.coalesce(F.col("_near"), F.col("_far"))
    return joined.select(*df.columns, *[chosen[v].alias(prefix + v) for v in values])


def lookup(facts: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Look facts up in a table unique by ``keys``.

    A small table is broadcast by its measured size. Otherwise a hot key's facts are split over tasks by the
    skewed-join rule, which repeats only that key's one lookup row; nothing is repeated for the other keys.
    """
    return facts.join(dim, list(keys), how)


def last_known(
    df: DataFrame, keys: Sequence[str], order: str, block: Column, value: str, name: str, inclusive: bool = False
) -> DataFrame:
    """Latest non-null ``value`` before each row (or up to it), computed block by block."""
    keys = list(keys)
    tagged = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    local = tagged.select("*", F.last(value, ignorenulls=True).over(inside).alias("_near"))
    ends = tagged.groupBy(*keys, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_far"))
    joined = local.join(carried, [*keys, "_block"], "left")
    return joined.select(*df.columns, F.coalesce("_near", "_far").alias(name))
