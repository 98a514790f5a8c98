"""Profiling, sanitising and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions import scalars as S
from beaconry.operators import profile as P
from beaconry.plans.registry import query

_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax"]
_TYPES = {"BIGINT": "bigint", "INT": "int", "DOUBLE": "double", "STRING": "string", "TS": "timestamp_ntz"}
_EVENT_COLS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")]


@query("profile_shape", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{ty}' AS data_type, COUNT(*) AS n_rows, 6 AS n_columns FROM events"
    for i, (c, ty) in enumerate(_EVENT_COLS)))
def _shape(t):
    return P.shape(t.events)


# Blank out a share of the cells, so that missing values, NaN included, are there to be found.
def _with_gaps(t):
    return t.events.select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"),
        F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 != 0, F.col("value"))
        .alias("amount"))


@query("profile_missing", """
    WITH g AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind,
                      CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN value END AS amount FROM events)
    SELECT 'event_id' AS column_name, COUNT(*) - COUNT(event_id) AS missing_cells,
           round((COUNT(*) - COUNT(event_id)) * 100.0::DOUBLE / COUNT(*), 2) AS missing_pct FROM g
    UNION ALL SELECT 'kind', COUNT(*) - COUNT(kind), round((COUNT(*) - COUNT(kind)) * 100.0::DOUBLE / COUNT(*), 2) FROM g
    UNION ALL SELECT 'amount', COUNT(*) - COUNT(amount),
           round((COUNT(*) - COUNT(amount)) * 100.0::DOUBLE / COUNT(*), 2) FROM g""")
def _missing(t):
    return P.missing(_with_gaps(t))


@query("profile_numeric", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, round(AVG({c}), 4) AS mean, round(CAST(median({c}) AS DOUBLE), 4) AS median,
           round(stddev_samp({c}), 4) AS std, round(CAST(MIN({c}) AS DOUBLE), 4) AS min,
           round(CAST(MAX({c}) AS DOUBLE), 4) AS max, round(skewness({c}), 4) AS skew FROM lineitem""" for c in _LINE))
def _numeric(t):
    return P.numeric_summary(t.lineitem)


_CATS = ["o_orderstatus", "o_orderpriority"]


def _escape_sql(c: str, n: int) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{raw}', '{entity}')"
    return f"substr({c}, 1, {n})"


@query("profile_categorical", f"""
    WITH p AS (SELECT 'lang' AS column_name, lang AS v FROM documents UNION ALL SELECT 'source', source FROM documents
               UNION ALL SELECT 'text', text FROM documents),
         c AS (SELECT column_name, v, COUNT(*) AS n FROM p WHERE v IS NOT NULL GROUP BY 1, 2),
         r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS place,
                      COUNT(*) OVER (PARTITION BY column_name) AS unique_values FROM c)
    SELECT column_name, unique_values, CAST(place AS INT) AS place, {_escape_sql('v', 64)} AS value, n
    FROM r WHERE place <= 5""")
def _categorical(t):
    return P.categorical_top(t.documents)


@query("profile_json")
def _profile_json(t):
    return P.profile_json(t.orders)


def _cells_sql(columns):
    return " || ".join(f"coalesce('s' || length({c}) || ':' || {c}, 'n')" for c in (f"CAST({c} AS VARCHAR)" for c in columns))


def _print_sql(columns):
    halves = ", ".join(f"coalesce(SUM(('0x' || substr(md5({_cells_sql(columns)}), {at}, 16))::UBIGINT::HUGEINT), 0)" for at in (1, 17))
    return f"sha256(concat_ws('|', COUNT(*), {halves}))"


_EVENTS = [c for c, _ in _EVENT_COLS]


@query("dataset_fingerprint", f"SELECT COUNT(*) AS n_rows, {_print_sql(_EVENTS)} AS fingerprint FROM events")
def _fingerprint(t):
    return P.fingerprint(t.events)


@query("infer_datetime", """
    SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n, SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS views
    FROM events GROUP BY 1""")
def _infer_datetime(t):
    texts = t.events.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"), "event_type")
    typed = P.infer_datetimes(texts)
    return typed.groupBy(F.to_date("seen_at").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("views"))


@query("preview_rows", f"""
    SELECT page_id, {_escape_sql('url', 2000)} AS url, {_escape_sql('html', 2000)} AS html
    FROM pages ORDER BY page_id LIMIT 100""")
def _preview(t):
    return P.preview(t.pages, "page_id")


@query("sanitize_text", f"""
    SELECT page_id, {_escape_sql('html', 2000)} AS clean, {_escape_sql('html', 64)} AS short FROM pages""")
def _sanitize_text(t):
    return t.pages.select(
        "page_id", S.sanitize_text(F.col("html")).alias("clean"), S.sanitize_text(F.col("html"), 64).alias("short"))


@query("sanitize_column_name", r"""
    SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(url, '[^a-zA-Z0-9_\s]', '', 'g'), chr(32)||chr(9)||chr(10)||chr(13)), 1, 64), ''),
                             'unnamed_column') AS safe_name FROM pages""")
def _sanitize_column_name(t):
    return t.pages.select("page_id", S.sanitize_column_name(F.col("url")).alias("safe_name"))


@query("sanitize_filename", r"""
    SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(url, '[^a-zA-Z0-9_\-. ]', '', 'g')), 1, 128), ''),
                             'unnamed_file') AS safe_name FROM pages""")
def _sanitize_filename(t):
    return t.pages.select("page_id", S.sanitize_filename(F.col("url")).alias("safe_name"))


_ODD = """
    WITH x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CAST('nan' AS DOUBLE)
                    WHEN event_id % 5 = 1 THEN CAST('inf' AS DOUBLE)
                    WHEN event_id % 5 = 2 THEN CAST('-inf' AS DOUBLE) ELSE value END AS v FROM events)"""


def _odd(t):
    k = F.col("event_id") % 5
    return t.events.select("event_id", F.when(k == 0, float("nan")).when(k == 1, float("inf"))
                           .when(k == 2, float("-inf")).otherwise(F.col("value")).alias("v"))


@query("safe_float", _ODD + " SELECT event_id, CASE WHEN isfinite(v) THEN v END AS safe_value FROM x")
def _safe_float(t):
    return _odd(t).select("event_id", S.safe_float(F.col("v")).alias("safe_value"))


@query("finite_clip", _ODD + " SELECT event_id, CASE WHEN isfinite(v) THEN v ELSE 1e9 END AS clipped FROM x")
def _finite_clip(t):
    return _odd(t).select("event_id", S.finite_clip(F.col("v")).alias("clipped"))


@query("injection_scan", r"""
    SELECT split_part(url, '/', 3) AS host, COUNT(*) AS pages, SUM(CASE WHEN regexp_matches(lower(html),
             '<script|url\s*\(|expression\s*\(|@import|javascript\s*:|-moz-binding\s*:') THEN 1 ELSE 0 END)::BIGINT
             AS flagged
    FROM pages GROUP BY 1""")
def _injection(t):
    flagged = t.pages.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"),
                             S.has_dangerous_markup(F.col("html")).alias("bad"))
    return flagged.groupBy("host").agg(F.count("*").alias("pages"), F.count_if("bad").alias("flagged"))


_DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@query("report_cache", f"""
    WITH f AS (SELECT source, {_print_sql(_DOCUMENTS)} AS fingerprint FROM documents GROUP BY source),
         done AS (SELECT fingerprint FROM f WHERE ('0x' || substr(fingerprint, 1, 2))::INT < 128)
    SELECT source, fingerprint FROM f WHERE fingerprint NOT IN (SELECT fingerprint FROM done)""")
def _report_cache(t):
    prints = P.fingerprint(t.documents, by=["source"])
    stored = prints.where(F.conv(F.substring("fingerprint", 1, 2), 16, 10).cast("int") < 128).select("fingerprint")
    return prints.join(stored, "fingerprint", "left_anti").select("source", "fingerprint")
