"""Chains of triggers with a pause: from a trigger, the next one is the first hit at least ``pause`` later.

Which hits trigger depends on all hits before them, yet no task ever walks a whole series. Time is cut into blocks, and blocks
into spans of blocks. Going up, a block tells for every hit that may be its first trigger which of its hits
would be its last: since the trigger before lies outside, only the hits of its first ``pause`` seconds and the next one can be
the first. Spans compose the answers of their blocks in the same way. Going down, the first trigger of a span tells the first
triggers of its blocks, and these the triggers themselves. Times are whole seconds and equal times are one hit, so
a block, a span and the list of a series' spans are bounded by the calendar, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.session import stored

BLOCK_SECONDS = 86_400
BLOCKS_PER_SPAN = 64


def last_of_chain(first: np.ndarray, last: np.ndarray, pause: int) -> np.ndarray:
    """For each entry (its time, the last trigger it leads to inside its part): the last trigger of the whole list.

    Entries rise in time. The chain goes on at the first entry at least ``pause`` after the last trigger; jumps are doubled.
    """
    n = len(first)
    jump = np.append(np.searchsorted(first, last + pause), n)
    end = np.append(last, 0)
    while True:
        on = jump[:n] < n
        if not on.any():
            return end[:n]
        end[:n] = np.where(on, end[jump[:n]], end[:n])
        jump[:n] = jump[jump[:n]]


def visited(first: np.ndarray, last: np.ndarray, start: int, pause: int) -> np.ndarray:
    """Indices of the entries that the chain from time ``start`` passes."""
    jump = np.searchsorted(first, last + pause)
    at, out = int(np.searchsorted(first, start)), []
    while at < len(first):
        out.append(at)
        at = int(jump[at])
    return np.array(out, np.int64)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _climb(parts: DataFrame, keys: list[str], length: int, pause: int) -> DataFrame:
    """Rows (keys, first, last) of the possible first triggers of each group, whose own parts are rows (keys, first, last)."""

    def work(table: pa.Table) -> pa.Table:
        first, last = _columns(table, "first", "last")
        order = np.argsort(first)
        first, last = first[order], last[order]
        begin = int(first[0]) // length * length
        keep = slice(0, int(np.searchsorted(first, begin + pause)) + 1)
        end = last_of_chain(first, last, pause)
        n = len(first[keep])
        return pa.table([*[table.column(k).slice(0, 1).take(pa.array(np.zeros(n, np.int64))) for k in keys],
                         pa.array(first[keep]), pa.array(end[keep])], names=[*keys, "first", "last"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*keys).schema)
    return parts.groupBy(*keys).applyInArrow(work, f"{schema}, first bigint, last bigint")


def _descend(parts: DataFrame, starts: DataFrame, keys: list[str], pause: int) -> DataFrame:
    """Of each group's parts, those that the chain from the group's start passes: rows (parts' columns)."""
    schema = parts.schema
    columns = parts.columns

    def work(table: pa.Table, start: pa.Table) -> pa.Table:
        if not table.num_rows or not start.num_rows:
            return table.slice(0, 0).select(columns)
        first, last = _columns(table, "first", "last")
        order = np.argsort(first)
        at = visited(first[order], last[order], start.column("start")[0].as_py(), pause)
        return table.take(pa.array(order[at])).select(columns)

    return parts.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInArrow(work, schema)


def triggers(
    hits: DataFrame, key: str, at: str, pause: int, not_before: DataFrame | None = None,
    block_seconds: int = BLOCK_SECONDS, blocks_per_span: int = BLOCKS_PER_SPAN,
) -> DataFrame:
    """Rows (key, at) of the hits that trigger. ``not_before`` (key, at) holds back a key's first trigger until then."""
    length = max(block_seconds, pause)
    span = length * blocks_per_span

    def number(of: Column, size: int) -> Column:
        return F.floor(of / size).cast("bigint")

    seconds = F.col(at).cast("bigint")
    rows = hits.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), seconds.alias("first"))
    if not_before is not None:
        held = not_before.select(F.col(key).alias("key"), F.col(at).cast("bigint").alias("_from"))
        rows = rows.join(held, "key", "left").where(F.col("_from").isNull() | (F.col("first") >= F.col("_from"))).drop("_from")
    points = stored(rows.distinct().select(
        "key", number(F.col("first"), span).alias("span"), number(F.col("first"), length).alias("block"), "first",
        F.col("first").alias("last")), "hits")
    blocks = stored(_climb(points, ["key", "span", "block"], length, pause), "blocks")
    spans = stored(_climb(blocks.drop("block"), ["key", "span"], span, pause), "spans")
    earliest = spans.groupBy("key").agg(F.min("first").alias("start"))
    in_spans = _descend(spans, earliest, ["key"], pause).select("key", "span", F.col("first").alias("start"))
    in_blocks = _descend(blocks, in_spans, ["key", "span"], pause).select("key", "span", "block", F.col("first").alias("start"))
    found = _descend(points, in_blocks, ["key", "span", "block"], pause)
    return found.select(F.col("key").alias(key), F.col("first").alias(at))
