"""Dataset profiling: shape, missing cells, numeric and categorical summaries, fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.functions.histograms import clean, exact_quantiles
from beaconry.functions.scalars import is_missing, safe_float, sanitize_text

TOP_VALUES, VALUE_CHARS, TIE_CHARS = 5, 64, 256


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def safe_names(names: list[str]) -> dict[str, str]:
    """Cleaned column names; a name that is already taken gets ``_2``, ``_3`` ..."""
    import re

    out: dict[str, str] = {}
    for name in names:
        base = re.sub(r"[^a-zA-Z0-9_\s]", "", str(name)).strip()[:64] or "unnamed_column"
        chosen, n = base, 1
        while chosen in out.values():
            n += 1
            chosen = f"{base}_{n}"
        out[name] = chosen
    return out


def _long(row: DataFrame, entries: list) -> DataFrame:
    return row.select(F.inline(F.array(*entries)))


def shape(df: DataFrame) -> DataFrame:
    """One row per column: position, cleaned name, type, and the table's row and column count."""
    names = safe_names(df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return _long(df.agg(F.count("*").alias("_n")), [
        F.struct(
            F.lit(i).alias("position"), F.lit(names[c]).alias("column_name"), F.lit(types[c]).alias("data_type"),
            F.col("_n").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
        for i, c in enumerate(df.columns)
    ])


def missing(df: DataFrame) -> DataFrame:
    """Missing cells per column (null or NaN) from one pass over the table."""
    names = safe_names(df.columns)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    row = df.agg(F.count("*").alias("_n"), *[
        F.count_if(is_missing(F.col(c), c in floats)).alias(f"_m{i}") for i, c in enumerate(df.columns)])
    return _long(row, [
        F.struct(
            F.lit(names[c]).alias("column_name"), F.col(f"_m{i}").alias("missing_cells"),
            F.round(F.try_divide(F.col(f"_m{i}") * 100.0, F.col("_n")), 2).alias("missing_pct"))
        for i, c in enumerate(df.columns)
    ])


def corrected_skew(skew, n):
    """Bias-corrected skewness from the population one; null below three values."""
    return F.when(n >= 3, skew * F.sqrt(n * (n - 1)) / (n - 2))


def numeric_summary(df: DataFrame, digits: int = 4, columns: list[str] | None = None) -> DataFrame:
    """Mean, median, sample deviation, min, max and skew of the numeric columns (or of those named).

    Moments come from one map-side aggregate. The exact medians are found beforehand by zooming
    histograms, so no task ever holds or sorts a column.
    """
    cols = numeric_columns(df) if columns is None else list(columns)
    if not cols:
        raise ValueError("no numeric columns to summarise")
    names = safe_names(df.columns)
    narrow = df.select(*cols)
    medians = exact_quantiles(narrow, cols, {"median": 0.5})
    stats = narrow.select(*[clean(c).alias(c) for c in cols]).agg(*[
        F.struct(
            F.lit(names[c]).alias("column_name"), F.avg(c).alias("mean"),
            F.lit(medians.get(c, {}).get("median")).cast("double").alias("median"),
            F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
            corrected_skew(F.skewness(c), F.count(c)).alias("skew"),
        ).alias(f"s{i}")
        for i, c in enumerate(cols)
    ]).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(cols))])))
    measures = ["mean", "median", "std", "min", "max", "skew"]
    return stats.select("column_name", *[safe_float(F.round(F.col(m), digits)).alias(m) for m in measures])


def categorical_top(df: DataFrame, top: int = TOP_VALUES, columns: list[str] | None = None) -> DataFrame:
    """Distinct count and most frequent values of the text columns (or of those named).

    Values are counted by a 128-bit hash, so long texts are not shuffled; each keeps only the first characters,
    by which ties are broken (then by the hash). The texts of the winners come from a second scan, joined by their few hashes.
    """
    cols = text_columns(df) if columns is None else list(columns)
    if not cols:
        raise ValueError("no text columns to summarise")
    names = safe_names(df.columns)
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(names[c]).alias("column_name"), F.col(c).alias("value")) for c in cols
    ]))).where(F.col("value").isNotNull()).select(
        "column_name", F.unhex(F.md5(F.col("value").cast("binary"))).alias("_h"), "value")
    counts = pairs.groupBy("column_name", "_h").agg(F.count("*").alias("n"), F.min(F.substring("value", 1, TIE_CHARS)).alias("_tie"))
    distinct = counts.groupBy("column_name").agg(F.count("*").alias("unique_values"))
    place = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("_tie"), F.asc("_h"))
    ranked = counts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)
    # top rows of each column, at most columns x top
    texts = pairs.join(F.broadcast(ranked.select("column_name", "_h")), ["column_name", "_h"]).groupBy(
        "column_name", "_h").agg(F.min(F.substring("value", 1, VALUE_CHARS)).alias("value"))
    return ranked.join(texts, ["column_name", "_h"]).join(F.broadcast(distinct), "column_name").select(  # one row per column
        "column_name", "unique_values", "place", sanitize_text(F.col("value"), VALUE_CHARS).alias("value"), "n")


def fingerprint(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Order-free content hash of all columns: row count and two 64-bit sums over row hashes, hashed again.

    Every cell is written with its length, null apart from any text, so different rows never read alike.
    """
    columns = columns or df.columns
    cells = [F.col(c).cast("string") for c in columns]
    text = F.concat(*[F.coalesce(F.concat(F.lit("s"), F.length(c).cast("string"), F.lit(":"), c), F.lit("n")) for c in cells])
    digest = F.md5(text.cast("binary"))
    sums = [F.coalesce(F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
            .alias(f"_s{at}") for at in (1, 17)]
    parts = [F.col(c).cast("string") for c in ("n_rows", "_s1", "_s17")]
    grouped = df.groupBy(*(by or []))
    return grouped.agg(F.count("*").alias("n_rows"), *sums).select(
        *(by or []), "n_rows", F.sha2(F.concat_ws("|", *parts).cast("binary"), 256).alias("fingerprint"))


def profile_json(df: DataFrame) -> DataFrame:
    """The whole profile as one JSON document; it holds aggregates only, never raw rows."""
    def packed(part: DataFrame, key: str) -> DataFrame:
        fields = F.struct(*[F.col(c) for c in part.columns])
        return part.agg(F.sort_array(F.collect_list(fields)).alias(key))

    parts = [packed(shape(df), "shape"), packed(missing(df), "missing")]
    if numeric_columns(df):
        parts.append(packed(numeric_summary(df), "numeric_summary"))
    if text_columns(df):
        parts.append(packed(categorical_top(df), "categorical_summary"))
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:  # one-row frames
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    out = out.drop("_one")
    return out.select(F.to_json(F.struct(*out.columns)).alias("profile"))


def infer_datetimes(df: DataFrame) -> DataFrame:
    """Cast a text column to timestamp when every non-null value parses; one pass for all."""
    cols = text_columns(df)
    if not cols:
        return df
    row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.count(F.try_to_timestamp(F.col(c))).alias(f"p{i}") for i, c in enumerate(cols)]).first()
    dates = {c for i, c in enumerate(cols) if row[f"n{i}"] and row[f"n{i}"] == row[f"p{i}"]}
    return df.select(*[
        F.try_to_timestamp(F.col(c)).alias(c) if c in dates else F.col(c) for c in df.columns])


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows by an explicit order; ties are broken by the whole row."""
    rest = [c for c in df.columns if c not in order]
    return df.orderBy(*order, *rest).limit(n)


def preview(df: DataFrame, *order: str, n: int = 100, max_len: int = 2000) -> DataFrame:
    texts = set(text_columns(df))
    return first_rows(df, n, *order).select(*[
        sanitize_text(F.col(c), max_len).alias(c) if c in texts else F.col(c) for c in df.columns])
