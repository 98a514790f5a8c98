"""Scalar column helpers, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of the replacements and the length limits matter.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
# Fixed value: style or script constructs that must not appear in stored markup.
DANGEROUS_MARKUP = r"(?i)(<script|url\s*\(|expression\s*\(|@import|javascript\s*:|-moz-binding\s*:)"

BAR_FULL, BAR_EMPTY = "█", "░"
# Fixed value: what NaN and infinities become in model inputs.
FINITE_LIMIT = 1e9


def sanitize_text(c: Column, max_len: int = 2000) -> Column:
    """Escape HTML first and cut afterwards, so an entity may end up cut in half."""
    out = c.cast("string")
    for raw, entity in HTML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return F.substring(out, 1, max_len)


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _keep_or_default(c: Column, drop: str, max_len: int, default: str) -> Column:
    kept = F.substring(strip(F.regexp_replace(c.cast("string"), drop, "")), 1, max_len)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def sanitize_column_name(c: Column) -> Column:
    return _keep_or_default(c, r"(?U)[^a-zA-Z0-9_\s]", 64, "unnamed_column")


def sanitize_filename(c: Column) -> Column:
    return _keep_or_default(c, r"[^a-zA-Z0-9_\-. ]", 128, "unnamed_file")


def has_dangerous_markup(c: Column) -> Column:
    return F.coalesce(c.rlike(DANGEROUS_MARKUP), F.lit(False))


def _non_finite(c: Column) -> Column:
    c = c.cast("double")
    return F.isnan(c) | c.isin(float("inf"), float("-inf"))


def safe_float(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~_non_finite(c), c.cast("double"))


def finite_clip(c: Column, default: float = FINITE_LIMIT) -> Column:
    """NaN and infinities become ``default``; null stays null."""
    return F.when(_non_finite(c), F.lit(default)).otherwise(c.cast("double"))


def is_missing(c: Column, numeric: bool) -> Column:
    return (c.isNull() | F.isnan(c)) if numeric else c.isNull()


def falsy_text(*choices: Column, default: str | None = None) -> Column:
    """First choice that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in choices], F.lit(default))


def falsy_number(*choices: Column, default: float = 0.0) -> Column:
    """First choice that is neither null, NaN nor zero."""
    picked = [F.nullif(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)) for c in choices]
    return F.coalesce(*picked, F.lit(default))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two time-zone-free timestamps, rounded down."""
    def into_day(c: Column) -> Column:
        return c.cast("timestamp_ntz") - F.to_date(c).cast("timestamp_ntz")

    whole = F.date_diff(F.to_date(later), F.to_date(earlier))
    return whole - F.when(into_day(later) < into_day(earlier), 1).otherwise(0)


def severity_score(c: Column) -> Column:
    return F.when(c == "critical", 100).when(c == "high", 75).otherwise(50)


def score_clamp(text: Column) -> Column:
    """Clamp a score given as text to 0..100; text that is no whole number gives 0."""
    whole = F.when(strip(text).rlike(r"^[+-]?\d{1,18}$"), strip(text)).cast("bigint")
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(whole, F.lit(0)))).cast("int")


def score_band(c: Column) -> Column:
    return F.when(c >= 80, "good").when(c >= 60, "warn").otherwise("bad")


def code_map(c: Column, codes: dict[str, str], default: str) -> Column:
    """Display code of an enum value; unknown or null gives the default."""
    out = F.lit(default)
    for key, code in reversed(list(codes.items())):
        out = F.when(c == key, code).otherwise(out)
    return out


def fmt_pct(c: Column) -> Column:
    """Share as a percentage of ten characters, right-aligned."""
    return F.when(c.isNotNull(), F.format_string("%9.2f%%", c * 100)).otherwise(F.lpad(F.lit("N/A"), 10, " "))


def spark_bar(c: Column, width: int = 20) -> Column:
    filled = F.bround(c * width).cast("int")
    bar = F.concat(F.repeat(F.lit(BAR_FULL), filled), F.repeat(F.lit(BAR_EMPTY), F.lit(width) - filled))
    return F.coalesce(bar, F.repeat(F.lit("?"), F.lit(width)))


def hash_share(key: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) for every key, the same on every run."""
    head = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10)
    return head.cast("double") / F.lit(4294967296.0)


def ratio_or_infinite(top: Column, bottom: Column) -> Column:
    """Division where x/0 is infinite with the sign of x and 0/0 is null."""
    return (
        F.when(bottom != 0, F.try_divide(top, bottom))
        .when(top > 0, F.lit(float("inf")))
        .when(top < 0, F.lit(float("-inf")))
    )
