"""Robustness checks of a classifier, each over a whole table of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.operators.training import Trained, by_cell
from beaconry.session import stored

# Perturbation, classes and risk order.
FACTOR, CLASSES, REPEATS = 1.01, (0, 1), 5
RISKS = ("low", "medium", "high", "critical")
EXTREMES = ("zero", "huge", "negative", "infinite")


def _cells(trained: Trained, df: DataFrame, variants: dict[str, dict[str, Column]]) -> DataFrame:
    """One cell column per variant of a row, side by side, and nothing else."""
    features = trained.features
    out = df.withColumn("_in", F.struct(*features))
    for name, changed in variants.items():
        shaped = out.withColumns({f: changed.get(f, F.col("_in")[f]) for f in features})
        out = trained.cell(shaped, name).withColumns({f: F.col("_in")[f] for f in features})
    return out.select(*variants)


def _total(which: Column) -> Column:
    """The rows behind those counts ``n`` that fulfil a condition."""
    return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))


def perturbation(trained: Trained, df: DataFrame, factor: float = FACTOR) -> DataFrame:
    """Rows whose class flips when one feature grows by one percent, per feature.

    Rows are counted by the cells that they lie in before and after; each cell is scored once. A row that stays in its cell
    keeps its class.
    """
    features = trained.features
    variants = {"_base": {}, **{f"_p{i}": {f: F.col("_in")[f] * factor} for i, f in enumerate(features)}}
    pairs = _cells(trained, df, variants).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(F.col("_base") != F.col(f"_p{i}"), F.col("_base")).alias("base"),
                 F.when(F.col("_base") != F.col(f"_p{i}"), F.col(f"_p{i}")).alias("changed"))
        for i in range(len(features))]))).groupBy("i", "base", "changed").agg(F.count("*").alias("n"))
    pairs = stored(pairs, "pairs")
    both = pairs.where(F.col("base").isNotNull()).select(F.explode(F.array("base", "changed")).alias("cell"))
    classes = stored(trained.score_cells(both, "cell"), "classes")
    before, after = (classes.select(F.col("cell").alias(c), F.col("prediction").alias(f"{c}_class")) for c in ("base", "changed"))
    sums = pairs.join(before, "base", "left").join(after, "changed", "left").groupBy("i").agg(
        F.sum("n").alias("records"), F.sum(F.when(F.col("base_class") != F.col("changed_class"), F.col("n"))).alias("flips"))
    every = df.sparkSession.range(len(features)).select(F.col("id").cast("int").alias("i"))  # a table without records has no sums
    return every.join(sums, "i", "left").select(
        F.get(F.array(*[F.lit(f) for f in features]), F.col("i")).alias("feature"), *[
            F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "flips")]).withColumn(
        "flip_rate", F.try_divide("flips", "records"))


def boundary(trained: Trained, df: DataFrame, grid: dict[str, float]) -> DataFrame:
    """Groups of near rows (same grid cell) in which every row gets another class."""
    cells = [F.floor(F.col(f) / width).alias(f"cell_{f}") for f, width in grid.items()]
    groups = trained.score_table(df).groupBy(*cells).agg(
        F.count("*").alias("records"), F.count_distinct("prediction").alias("classes"))
    return groups.where((F.col("records") > 1) & (F.col("classes") == F.col("records")))


def extremes(trained: Trained, df: DataFrame) -> DataFrame:
    """Zero, huge, negative and infinite inputs must still give a known class.

    All variants of all rows are prepared and counted by the cells they lie in, which are few; each cell is scored.
    """
    fs = trained.features
    variants = {
        "zero": {f: F.lit(0.0) for f in fs}, "huge": {f: F.abs(F.col("_in")[f]) * 1e9 for f in fs},
        "negative": {f: -F.abs(F.col("_in")[f]) for f in fs}, "infinite": {f: F.lit(float("inf")) for f in fs}}
    cells = _cells(trained, df, variants).select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("variant"), F.col(v).alias("cell")) for v in variants]))).groupBy("variant", "cell").agg(
            F.count("*").alias("n"))
    scored = trained.class_of(by_cell(cells, "cell"), "cell", "class")
    known = F.coalesce(F.col("class").isin(*CLASSES), F.lit(False))
    return scored.agg(*[x for v in variants for x in (
        _total(F.col("variant") == v).alias(f"n_{v}"), _total((F.col("variant") == v) & ~known).alias(f"bad_{v}"))]).select(
            F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"n_{v}").alias("records"), F.col(f"bad_{v}").alias("bad"))
                               for v in variants])))


def schema_outcomes(trained: Trained, df: DataFrame) -> DataFrame:
    """One row for each feature: whether the table without it is refused, why, and how many records are held back or scored."""
    outcomes = []
    for f in trained.features:
        try:
            trained.score(df.drop(f))
            outcomes.append((f, False, None))
        except ValueError as e:
            outcomes.append((f, True, str(e)))
    cells = [F.struct(F.lit(f).alias("dropped"), F.lit(refused).alias("refused"), F.lit(why).cast("string").alias("reason"))
             for f, refused, why in outcomes]
    return df.agg(F.count("*").alias("records")).select("records", F.inline(F.array(*cells)))


def schema_refused(trained: Trained, df: DataFrame) -> bool:
    """Scoring without one of the features must fail."""
    return schema_outcomes(trained, df.limit(0)).where("not refused").isEmpty()


def repeatable(trained: Trained, df: DataFrame, times: int = REPEATS) -> DataFrame:
    """Rows whose class differs between repeated scorings.

    Every row is prepared and placed in its cell anew each time; rows that fell in the same cells are counted together,
    and their cell is scored anew each time.
    """
    first, *rest = names = [f"_r{i}" for i in range(times)]
    placed = _cells(trained, df, {n: {} for n in names})
    # a cell that equals the first one is left out of the key
    scored = by_cell(placed.select(first, *[F.when(F.col(n) != F.col(first), F.col(n)).alias(n) for n in rest]).groupBy(
        *names).agg(F.count("*").alias("n")).select("n", first, *[F.coalesce(n, first).alias(n) for n in rest]), first)
    for n in names:
        scored = trained.class_of(scored, n, f"{n}_class")
    same = F.size(F.array_distinct(F.array(*[F.col(f"{n}_class") for n in names]))) == 1
    return scored.agg(_total(F.lit(True)).alias("records"), _total(~same).alias("unstable"))


def results(trained: Trained, df: DataFrame, grid: dict[str, float], max_flip_rate: float = 0.0) -> DataFrame:
    """One row per check: passed, findings and risk."""
    def row(name: str, findings: Column, risk: str) -> list[Column]:
        return [F.lit(name).alias("test_name"), (findings == 0).alias("passed"), findings.cast("bigint").alias("findings"),
                F.when(findings == 0, "low").otherwise(risk).alias("risk_level")]

    schema = 0 if schema_refused(trained, df) else 1
    parts: Sequence[DataFrame] = (
        boundary(trained, df, grid).agg(F.count("*").alias("x")).select(*row("boundary_probing", F.col("x"), "medium")),
        perturbation(trained, df).agg(F.count_if(F.col("flip_rate") > max_flip_rate).alias("x")).select(
            *row("feature_perturbation", F.col("x"), "medium")),
        extremes(trained, df).agg(F.sum("bad").alias("x")).select(*row("payload_injection", F.col("x"), "high")),
        df.sparkSession.range(1).select(*row("schema_fuzzing", F.lit(schema), "medium")),
        repeatable(trained, df).select(*row("output_consistency", F.col("unstable"), "critical")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(checks: DataFrame, *keys: str) -> DataFrame:
    """Totals, overall risk (the highest of the failed checks) and names of the failed checks."""
    order = F.lit(0)
    for i, r in enumerate(RISKS):
        order = F.when(F.col("risk_level") == r, i).otherwise(order)
    failed = ~F.col("passed")
    worst = F.coalesce(F.max(F.when(failed, order)), F.lit(0))
    # the names of checks are few, whatever the number of rows
    return checks.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("passed").alias("n_passed"), F.count_if(failed).alias("n_failed"),
        F.element_at(F.array(*[F.lit(r) for r in RISKS]), worst + 1).alias("overall_risk"),
        F.array_join(F.sort_array(F.collect_set(F.when(failed, F.col("test_name")))), ",").alias("failed_tests"))
