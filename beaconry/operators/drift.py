"""Two-sample drift tests over whole tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions.histograms import long_values, ranges, with_bin
from beaconry.functions.ordered import ROWS_PER_TASK, find_cuts, running_totals
from beaconry.operators.profile import numeric_columns
from beaconry.session import stored
from beaconry.settings import DEFAULTS


def common_numeric_columns(one: DataFrame, other: DataFrame, label: str | None = None) -> list[str]:
    """Sorted numeric columns both sides share, without the label; none is an error."""
    shared = sorted((set(numeric_columns(one)) & set(numeric_columns(other))) - {label})
    if not shared:
        raise ValueError("the two tables share no numeric columns")
    return shared


def shared_features(one: DataFrame, other: DataFrame, label: str | None = None) -> DataFrame:
    """One row for each feature that both sides can be compared by, with the values either side has for it."""
    names = common_numeric_columns(one, other, label)

    def counted(df: DataFrame, n: str) -> DataFrame:
        counts = df.agg(*[F.count(c).alias(c) for c in names])
        return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias(n)) for c in names])))

    return counted(one, "baseline_n").join(counted(other, "current_n"), "feature")


def ks_p_value(distance: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p-value: Kolmogorov series of one hundred terms."""
    lam = distance * F.sqrt(n1 * n2 / (n1 + n2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def _gaps(cells: list, n1: float, n2: float) -> tuple[float, list]:
    """Largest gap at the bin ends, and the bins inside which a larger one is still possible."""
    best, c1, c2, open_bins = 0.0, 0, 0, []
    for cell in cells:
        before1, before2 = c1, c2
        c1, c2 = c1 + cell["n1"], c2 + cell["n2"]
        best = max(best, abs(c1 / n1 - c2 / n2))
        if cell["a"] < cell["b"]:
            reach = max(c1 / n1 - before2 / n2, c2 / n2 - before1 / n1)
            open_bins.append((reach, cell["bin"], before1, before2, cell["n1"] + cell["n2"]))
    return best, [x for x in open_bins if x[0] > best]


def ks_drift_sides(
    both: DataFrame, side: str, baseline: str, features: Sequence[str],
    alpha: float = DEFAULTS.drift_p_value, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Per feature: largest gap between the two empirical distributions, p-value and verdict.

    ``side`` tells the sample of a row, so both samples come from one scan. A histogram bounds the
    gap in every bin; only the values of bins that can still hold the largest gap are counted
    and ordered, each bin by itself. Bins too large for a task are cut by ``running_totals``.
    """
    spans = ranges(both, features)
    first = F.when(F.col(side) == baseline, 1).otherwise(0)
    tested = [f for f in features if f in spans]
    if not tested:
        raise ValueError("the features hold no values")
    order = [spans[f] for f in tested]
    named = F.get(F.array(*[F.lit(f) for f in tested]), F.col("span"))
    cells = with_bin(long_values(both.withColumn("_first", first), order, ["_first"]), order).select(
        "_first", named.alias("feature"), "bin", F.col("v").alias("value"))
    sums = [F.sum("_first").alias("n1"), F.sum(1 - F.col("_first")).alias("n2")]
    counted = cells.groupBy("feature", "bin").agg(*sums, F.min("value").alias("a"), F.max("value").alias("b")).collect()
    base, keep, large = [], [], set()
    for f in tested:  # at most BINS + 2 counts per feature
        mine = sorted((r for r in counted if r["feature"] == f), key=lambda r: r["bin"])
        n1, n2 = (float(sum(r[k] for r in mine)) for k in ("n1", "n2"))
        if not n1 or not n2:
            raise ValueError(f"feature {f} has no values on one side")
        best, candidates = _gaps(mine, n1, n2)
        base.append((f, best, n1, n2))
        keep += [(f, b, c1, c2) for _, b, c1, c2, _ in candidates]
        if any(x[4] > rows_per_task for x in candidates):
            large.add(f)
    spark = both.sparkSession
    known = spark.createDataFrame(base, "feature string, best double, all1 double, all2 double")
    offsets = spark.createDataFrame(keep, "feature string, bin int, before1 bigint, before2 bigint")
    wanted = cells.where(~F.col("feature").isin(*large)) if large else cells
    values = wanted.join(F.broadcast(offsets), ["feature", "bin"]).groupBy(
        "feature", "bin", "before1", "before2", "value").agg(*sums)
    upto = Window.partitionBy("feature", "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inner = values.select("feature", (F.col("before1") + F.sum("n1").over(upto)).alias("c1"),
                          (F.col("before2") + F.sum("n2").over(upto)).alias("c2"))
    if large:
        names = sorted(large)
        counts = cells.where(F.col("feature").isin(*names)).groupBy("feature", "value").agg(*sums)
        run = running_totals(counts, "feature", "value", ["n1", "n2"], find_cuts(both, names, rows_per_task))
        inner = inner.unionByName(run.select("feature", F.col("cum_n1").alias("c1"), F.col("cum_n2").alias("c2")))
    gaps = inner.join(F.broadcast(known), "feature").groupBy("feature").agg(
        F.max(F.abs(F.col("c1") / F.col("all1") - F.col("c2") / F.col("all2"))).alias("inner_gap"))
    found = known.join(F.broadcast(gaps), "feature", "left").withColumn(
        "d", F.greatest("best", F.coalesce("inner_gap", F.lit(0.0))))
    p = ks_p_value(F.col("d"), F.col("all1"), F.col("all2"))
    return found.withColumn("p", p).select(
        "feature", F.round("d", 6).alias("ks_statistic"), F.round("p", 6).alias("p_value"),
        F.coalesce(F.col("p") < alpha, F.lit(False)).alias("drift_detected"))


def ks_drift(
    baseline: DataFrame, current: DataFrame, label: str | None = None,
    alpha: float = DEFAULTS.drift_p_value, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Drift of every shared numeric column between two tables."""
    features = common_numeric_columns(baseline, current, label)
    both = baseline.select(*features, F.lit("baseline").alias("_side")).unionByName(
        current.select(*features, F.lit("current").alias("_side")))
    return ks_drift_sides(both, "_side", "baseline", features, alpha, rows_per_task)


def ks_from_counts(
    baseline: DataFrame, current: DataFrame, value: str, n: str, alpha: float = DEFAULTS.drift_p_value,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Drift of one feature from counts of its values, as streams keep them; counts of the same value add up."""
    sides = [df.select(F.col(value).cast("double").alias(value), F.when(F.lit(i == 0), F.col(n)).otherwise(0).alias("n1"),
                       F.when(F.lit(i == 1), F.col(n)).otherwise(0).alias("n2")) for i, df in enumerate((baseline, current))]
    clean = sides[0].unionByName(sides[1]).where(~F.isnan(value) & F.col(value).isNotNull())
    counts = clean.groupBy(F.lit(value).alias("feature"), F.col(value).alias("value")).agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    cuts = find_cuts(clean, [value], rows_per_task)
    totals = counts.groupBy("feature").agg(F.sum("n1").alias("all1"), F.sum("n2").alias("all2"))
    gaps = running_totals(counts, "feature", "value", ["n1", "n2"], cuts).join(F.broadcast(totals), "feature")
    found = gaps.groupBy("feature", "all1", "all2").agg(
        F.max(F.abs(F.col("cum_n1") / F.col("all1") - F.col("cum_n2") / F.col("all2"))).alias("d")).where("all1 > 0 AND all2 > 0")
    p = ks_p_value(F.col("d"), F.col("all1").cast("double"), F.col("all2").cast("double"))
    return found.withColumn("p", p).select(
        "feature", F.round("d", 6).alias("ks_statistic"), F.round("p", 6).alias("p_value"), (F.col("p") < alpha).alias("drift_detected"))


def _log_gamma(z: Column) -> Column:
    """Stirling's series ten steps up, and back down by logarithms."""
    up = z + 10
    series = 1 / (12 * up) - 1 / (360 * F.pow(up, F.lit(3.0))) + 1 / (1260 * F.pow(up, F.lit(5.0)))
    down = sum((F.log(z + i) for i in range(1, 10)), F.log(z))
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - down


def chi_squared_p_value(statistic: Column, freedom: Column) -> Column:
    """Upper tail of the chi-squared distribution: one less the series of the incomplete gamma function.

    Terms rise until about the statistic and fall from there; far out the tail is 0.
    """
    a, x = freedom.cast("double") / 2, statistic.cast("double") / 2
    far = x > 2 * a + 400
    n = F.least(F.ceil(x + 12 * F.sqrt(x + 1) + 60), F.ceil(2 * a + 1200)).cast("int")
    first = F.exp(-x + a * F.log(x) - _log_gamma(a + 1))
    start = F.struct(first.alias("term"), first.alias("sum"))
    grown = F.aggregate(
        F.sequence(F.lit(1), n), start,
        lambda acc, k: F.struct((acc["term"] * x / (a + k)).alias("term"), (acc["sum"] + acc["term"] * x / (a + k)).alias("sum")))
    tail = F.greatest(F.lit(0.0), 1 - grown["sum"])
    return F.when(freedom < 1, 1.0).when(x <= 0, 1.0).when(far, 0.0).otherwise(tail)


def chi_squared_drift(
    both: DataFrame, side: str, baseline: str, features: Sequence[str],
    alpha: float = DEFAULTS.drift_p_value, rare: float = 5.0,
) -> DataFrame:
    """Drift of text columns: chi-squared test of the two samples' category counts.

    Categories of which either sample would hold fewer than ``rare`` rows if both were alike are pooled to one cell.
    Null is a category of its own. A feature with one cell left has no degree of freedom and p 1.
    """
    first = F.when(F.col(side) == baseline, 1).otherwise(0)
    long_ = both.select(first.alias("_first"), F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("category")) for f in features])))
    counts = stored(long_.groupBy("feature", "category").agg(
        F.sum("_first").alias("n1"), F.sum(1 - F.col("_first")).alias("n2")), "categories")
    totals = counts.groupBy("feature").agg(F.sum("n1").cast("double").alias("all1"), F.sum("n2").cast("double").alias("all2"))
    shared = counts.join(F.broadcast(totals), "feature")  # one row for each feature
    expected = (F.col("n1") + F.col("n2")) * F.least("all1", "all2") / (F.col("all1") + F.col("all2"))
    pooled = shared.withColumn("_rare", expected < rare)
    by = ["feature", "all1", "all2"]
    rest = pooled.where("_rare").groupBy(*by).agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    cells = pooled.where("not _rare").select(*by, "n1", "n2").unionByName(rest)

    def part(n: str, whole: str) -> Column:
        wanted = (F.col("n1") + F.col("n2")) * F.col(whole) / (F.col("all1") + F.col("all2"))
        return F.coalesce(F.try_divide((F.col(n) - wanted) * (F.col(n) - wanted), wanted), F.lit(0.0))

    found = cells.groupBy("feature").agg(
        F.sum(part("n1", "all1") + part("n2", "all2")).alias("statistic"), (F.count("*") - 1).alias("freedom"))
    p = chi_squared_p_value(F.col("statistic"), F.col("freedom"))
    return found.withColumn("p", p).select(
        "feature", F.round("statistic", 6).alias("chi_squared"), "freedom", F.round("p", 6).alias("p_value"),
        (F.col("p") < alpha).alias("drift_detected"))


def drift_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("features_tested"), F.count_if("drift_detected").alias("features_drifted"),
        F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("any_drift"))


def drifted_features(report: DataFrame) -> DataFrame:
    return report.where("drift_detected").select("feature")
