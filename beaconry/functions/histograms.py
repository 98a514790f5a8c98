"""Exact order statistics by zooming histograms.

A histogram of equal-width bins is a map-side sum, so it costs a scan and moves a few thousand
counts. The bin number never falls as the value rises: a bin holds exactly the values
between its smallest and largest one. A rank is therefore found by choosing its bin and zooming
into it until few values are left. Every pass is a scan with a filter on the column; what
reaches the driver is bounded by bins times columns, whatever the size of the table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1_024
DIRECT_ROWS = 20_000      # so few values are fetched as they are


@dataclass(frozen=True)
class Span:
    """Values of one column between two of its values, and how many lie below."""

    column: str
    low: float
    high: float
    below: int
    rows: int
    whole: bool = False


def clean(column: str) -> Column:
    """The column as double without NaN."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None))


def long_values(df: DataFrame, spans: Sequence[Span], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep..., span, v): the values of every span's column that lie inside the span.

    The bounds are looked up by position after the columns are turned into rows, so the
    generated code stays small however many columns there are.
    """
    lows, highs = F.array(*[F.lit(float(s.low)) for s in spans]), F.array(*[F.lit(float(s.high)) for s in spans])
    rows = df.select(*keep, F.posexplode(F.array(*[clean(s.column) for s in spans])).alias("span", "v"))
    infinite = F.abs("v") == float("inf")
    whole = F.array(*[F.lit(s.below == 0 and s.whole) for s in spans])
    inside = F.col("v").between(F.get(lows, F.col("span")), F.get(highs, F.col("span")))
    return rows.where(F.col("v").isNotNull() & (inside | (infinite & F.get(whole, F.col("span")))))


def with_bin(rows: DataFrame, spans: Sequence[Span], bins: int = BINS) -> DataFrame:
    """Adds the equal-width bin of every value; infinite values get bins of their own at the ends."""
    lows = F.array(*[F.lit(float(s.low) / 2) for s in spans])
    widths = F.array(*[F.lit(float(s.high) / 2 - float(s.low) / 2) for s in spans])
    low, width, v = F.get(lows, F.col("span")), F.get(widths, F.col("span")), F.col("v")
    inner = F.when(width > 0, F.least(F.floor((v / 2 - low) / width * bins), F.lit(bins - 1))).otherwise(0)
    place = F.when(v == float("inf"), bins).when(v == float("-inf"), -1).otherwise(inner)
    return rows.withColumn("bin", place.cast("int"))


def ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, Span]:
    """Count and finite extremes per column from one aggregate; columns without values are left out."""
    aggs = []
    for i, c in enumerate(columns):
        v = clean(c)
        finite = F.when(F.abs(v) != float("inf"), v)
        aggs += [F.count(v).alias(f"n{i}"), F.min(finite).alias(f"a{i}"), F.max(finite).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    return {
        c: Span(c, row[f"a{i}"] if row[f"a{i}"] is not None else 0.0, row[f"b{i}"] if row[f"b{i}"] is not None else 0.0, 0, row[f"n{i}"], True)
        for i, c in enumerate(columns) if row[f"n{i}"]}


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Mapping[str, float]) -> dict[str, dict[str, float]]:
    """Linearly interpolated exact quantiles of every column: {column: {name: value}}."""
    whole = ranges(df, list(columns))
    wanted: dict[tuple[str, int], float | None] = {}
    for c, s in whole.items():
        for share in shares.values():
            place = (s.rows - 1) * float(share)
            wanted.update({(c, math.floor(place)): None, (c, math.ceil(place)): None})
    at = {key: whole[key[0]] for key in wanted}
    while at:
        spans = sorted(set(at.values()), key=lambda s: (s.column, s.low))
        direct = [s for s in spans if s.rows <= DIRECT_ROWS]
        zoom = [s for s in spans if s.rows > DIRECT_ROWS]
        found: dict[Span, list[tuple[float, float, int]]] = {}
        for group, binned in ((direct, False), (zoom, True)):
            if not group:
                continue
            rows = long_values(df, group)
            got = (with_bin(rows, group) if binned else rows).groupBy("span", "bin" if binned else "v").agg(
                F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()  # bounded, see above
            for r in sorted(got, key=lambda r: r["a"]):
                found.setdefault(group[r["span"]], []).append((r["a"], r["b"], r["n"]))
        for key, span in list(at.items()):
            below = span.below
            for a, b, n in found[span]:
                if below + n > key[1]:
                    break
                below += n
            if a == b:
                wanted[key] = a
                del at[key]
            else:
                at[key] = Span(span.column, a, b, below, n)
    out: dict[str, dict[str, float]] = {}
    for c, s in whole.items():
        for name, share in shares.items():
            place = (s.rows - 1) * float(share)
            lo, hi = wanted[(c, math.floor(place))], wanted[(c, math.ceil(place))]
            out.setdefault(c, {})[name] = lo if lo == hi else lo + (hi - lo) * (place - math.floor(place))
    return out
