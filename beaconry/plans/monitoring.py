"""Drift, scorecard, history and retraining-decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions import scalars as S
from beaconry.operators import drift as D
from beaconry.operators import history as H
from beaconry.operators import scorecard as C
from beaconry.plans.oracle_views import add_view
from beaconry.plans.registry import query
from beaconry.sources import bindings as B

_FEATURES = ["account_age", "merchant_risk", "num_transactions", "transaction_amount"]

add_view("ks_long", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS v, side FROM transactions WHERE {c} IS NOT NULL" for c in _FEATURES))
add_view("ks_raw", """
    WITH n AS (SELECT feature, v, SUM(CASE WHEN side = 'baseline' THEN 1 ELSE 0 END) AS n1,
                      SUM(CASE WHEN side = 'current' THEN 1 ELSE 0 END) AS n2 FROM ks_long GROUP BY 1, 2),
         c AS (SELECT feature, SUM(n1) OVER w AS c1, SUM(n2) OVER w AS c2, SUM(n1) OVER p AS t1, SUM(n2) OVER p AS t2
               FROM n WINDOW w AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature))
    SELECT feature, MAX(abs(c1::DOUBLE / t1 - c2::DOUBLE / t2)) AS d, MAX(t1)::DOUBLE AS n1, MAX(t2)::DOUBLE AS n2
    FROM c GROUP BY feature""")
add_view("ks_full", """
    WITH l AS (SELECT *, d * sqrt(n1 * n2 / (n1 + n2)) AS lam FROM ks_raw),
         s AS (SELECT feature, SUM((CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * lam * lam)) AS z
               FROM l, generate_series(1, 100) g(k) GROUP BY feature)
    SELECT l.*, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * z)) END::DOUBLE AS p
    FROM l JOIN s USING (feature)""")


def _ks(t):
    return D.ks_drift_sides(B.transactions(t), "side", "baseline", _FEATURES)


@query("ks_drift", """
    SELECT feature, round(d, 6) AS ks_statistic, round(p, 6) AS p_value, p < 0.05 AS drift_detected FROM ks_full""")
def _ks_drift(t):
    return _ks(t)


@query("ks_pvalue", """
    WITH e AS (SELECT event_id, value / 500 AS d, CAST(user_id + 50 AS DOUBLE) AS n1, 100.0::DOUBLE AS n2 FROM events),
         l AS (SELECT event_id, d * sqrt(n1 * n2 / (n1 + n2)) AS lam FROM e),
         s AS (SELECT event_id, lam, SUM((CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * lam * lam)) AS z
               FROM l, generate_series(1, 100) g(k) GROUP BY 1, 2)
    SELECT event_id, round(CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * z)) END::DOUBLE, 6) AS p_value
    FROM s""")
def _ks_pvalue(t):
    e = t.events.select("event_id", (F.col("value") / 500).alias("d"), (F.col("user_id") + 50).cast("double").alias("n1"))
    return e.select("event_id", F.round(D.ks_p_value(F.col("d"), F.col("n1"), F.lit(100.0)), 6).alias("p_value"))


@query("chi_drift", """
    WITH b AS (SELECT unnest([{'f': 'l_returnflag', 'c': l_returnflag}, {'f': 'l_linestatus', 'c': l_linestatus},
                              {'f': 'ship_month', 'c': strftime(l_shipdate, '%Y-%m')}]) AS r, l_shipdate < TIMESTAMP '1997-01-01' AS base FROM lineitem),
         n AS (SELECT r.f AS feature, r.c AS c, SUM(base::INT) AS n1, SUM((NOT base)::INT) AS n2 FROM b GROUP BY 1, 2),
         t AS (SELECT *, SUM(n1) OVER w::DOUBLE AS a1, SUM(n2) OVER w::DOUBLE AS a2 FROM n WINDOW w AS (PARTITION BY feature)),
         g AS (SELECT feature, a1, a2, CASE WHEN (n1 + n2) * least(a1, a2) / (a1 + a2) < 5 THEN '' ELSE 'c' || c END AS cell, SUM(n1) AS n1, SUM(n2) AS n2
               FROM t GROUP BY ALL),
         s AS (SELECT feature, SUM(power(n1 - (n1 + n2) * a1 / (a1 + a2), 2) / nullif((n1 + n2) * a1 / (a1 + a2), 0)
                                 + power(n2 - (n1 + n2) * a2 / (a1 + a2), 2) / nullif((n1 + n2) * a2 / (a1 + a2), 0)) AS x, COUNT(*) - 1 AS k FROM g GROUP BY 1),
         p AS (SELECT *, CASE WHEN k < 1 OR x <= 0 THEN 1.0 WHEN x > 2 * k + 800 THEN 0.0 ELSE greatest(0.0, 1 - (
                 SELECT SUM(exp(-x / 2 + (k / 2.0 + i) * ln(x / 2) - lgamma(k / 2.0 + i + 1))) FROM generate_series(0, 3000) g(i))) END AS p FROM s)
    SELECT feature, round(x, 6) AS chi_squared, k AS freedom, round(p, 6)::DOUBLE AS p_value, p < 0.05 AS drift_detected FROM p""")
def _chi_drift(t):
    """Text columns of the order lines, shipped before 1997 and after."""
    lines = t.lineitem.select(
        "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM").alias("ship_month"),
        F.when(F.col("l_shipdate") < F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"), "baseline").otherwise("current").alias("side"))
    return D.chi_squared_drift(lines, "side", "baseline", ["l_returnflag", "l_linestatus", "ship_month"])


@query("drift_summary", """
    SELECT COUNT(*) AS features_tested, SUM(CASE WHEN p < 0.05 THEN 1 ELSE 0 END)::BIGINT AS features_drifted,
           bool_or(p < 0.05) AS any_drift FROM ks_full""")
def _drift_summary(t):
    return D.drift_summary(_ks(t))


def _vs_scaled(t):
    tx = B.transactions(t)
    now = tx.where("side = 'current'")
    return D.ks_drift(tx.where("side = 'baseline'"), now.withColumn(
        "transaction_amount", F.col("transaction_amount") * 1.5).withColumn(
        "merchant_risk", F.least(F.col("merchant_risk") + 1, F.lit(5.0))).select(*_FEATURES, "label"), "label")


@query("drifted_features", """
    WITH x AS (SELECT 'transaction_amount' AS feature,
                      CASE WHEN side = 'current' THEN transaction_amount * 1.5 ELSE transaction_amount END AS v, side FROM transactions
               UNION ALL SELECT 'merchant_risk', CASE WHEN side = 'current' THEN least(merchant_risk + 1, 5.0) ELSE merchant_risk END, side
               FROM transactions
               UNION ALL SELECT feature, v, side FROM ks_long WHERE feature IN ('account_age', 'num_transactions')),
         n AS (SELECT feature, v, SUM((side = 'baseline')::INT) AS n1, SUM((side = 'current')::INT) AS n2 FROM x GROUP BY 1, 2),
         c AS (SELECT feature, SUM(n1) OVER w AS c1, SUM(n2) OVER w AS c2, SUM(n1) OVER p AS t1, SUM(n2) OVER p AS t2
               FROM n WINDOW w AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature)),
         d AS (SELECT feature, MAX(abs(c1::DOUBLE / t1 - c2::DOUBLE / t2)) * sqrt(MAX(t1)::DOUBLE * MAX(t2) / (MAX(t1) + MAX(t2))) AS lam
               FROM c GROUP BY feature)
    SELECT feature FROM d WHERE lam >= 0.2 AND (SELECT least(1.0, 2.0 * SUM((CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END)
           * exp(-2.0 * k * k * lam * lam))) FROM generate_series(1, 100) g(k)) < 0.05""")
def _drifted(t):
    return D.drifted_features(_vs_scaled(t))


@query("confusion_matrix", """
    WITH l AS (SELECT actual AS label FROM predictions UNION SELECT prediction FROM predictions)
    SELECT a.label AS actual, p.label AS prediction,
           (SELECT COUNT(*) FROM predictions x WHERE x.actual = a.label AND x.prediction = p.label) AS n FROM l a, l p""")
def _confusion(t):
    return C.confusion_matrix(B.predictions(t))


add_view("class_scores", """
    WITH l AS (SELECT actual AS label FROM predictions UNION SELECT prediction FROM predictions),
         s AS (SELECT label, (SELECT COUNT(*) FROM predictions WHERE actual = label AND prediction = label) AS tp,
                      (SELECT COUNT(*) FROM predictions WHERE actual = label) AS support,
                      (SELECT COUNT(*) FROM predictions WHERE prediction = label) AS predicted FROM l)
    SELECT label, tp, support, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS pr,
           CASE WHEN support = 0 THEN 0 ELSE tp / support END AS rc,
           CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END AS f FROM s""")


@query("scorecard", """
    SELECT round(SUM(tp) / SUM(support), 4) AS accuracy, round(AVG(pr), 4) AS "precision", round(AVG(rc), 4) AS recall,
           round(AVG(f), 4) AS f1, SUM(support)::BIGINT AS total_predictions FROM class_scores""")
def _scorecard(t):
    return C.scorecard(B.predictions(t))


@query("class_report", """
    SELECT label, round(pr, 4) AS "precision", round(rc, 4) AS recall, round(f, 4) AS f1, support FROM class_scores""")
def _class_report(t):
    return C.class_report(B.predictions(t))


# Per document language, so that good and bad scorecards both occur.
def _cards_by_lang(t):
    return C.scorecard(B.predictions(t).join(t.documents.select("doc_id", "lang"), "doc_id"), "lang")


@query("accuracy_alert", """
    WITH a AS (SELECT lang, round(AVG(CASE WHEN actual = prediction THEN 1.0::DOUBLE ELSE 0 END), 4) AS acc
               FROM predictions JOIN documents USING (doc_id) GROUP BY lang)
    SELECT lang, 'accuracy' AS metric, acc AS value, 0.85::DOUBLE AS threshold, 'warning' AS severity,
           printf('accuracy %.4f is under the limit %.4f', acc, 0.85::DOUBLE) AS message FROM a WHERE acc < 0.85""")
def _accuracy_alert(t):
    return C.accuracy_alerts(_cards_by_lang(t))


@query("history_last_n", """
    SELECT * FROM (SELECT day, round(accuracy, 6) AS accuracy, total_predictions FROM metrics_history ORDER BY day DESC LIMIT 7)
    ORDER BY day""")
def _last_n(t):
    return H.last_n(B.metrics_history(t), "day", 7).withColumn("accuracy", F.round("accuracy", 6))


@query("history_latest", """
    SELECT day, round(accuracy, 6) AS accuracy, total_predictions FROM metrics_history ORDER BY day DESC LIMIT 1""")
def _latest(t):
    return H.latest(B.metrics_history(t), "day").withColumn("accuracy", F.round("accuracy", 6))


_BAR_SQL = ("repeat('█', CAST(round_even(accuracy * 20, 0) AS INT)) || "
            "repeat('░', 20 - CAST(round_even(accuracy * 20, 0) AS INT))")


@query("health_report", f"""
    SELECT day, CASE WHEN round(accuracy, 4) < 0.85 THEN 'FAIL' ELSE 'PASS' END AS status,
           printf('%9.2f%%', accuracy * 100) AS accuracy_text, {_BAR_SQL} AS bar, total_predictions
    FROM metrics_history ORDER BY day DESC LIMIT 14""")
def _health(t):
    return H.health_report(B.metrics_history(t), "day", 14)


@query("sink_report_text")
def _report_text(t):
    return H.report_text(H.health_report(B.metrics_history(t), "day", 14), "day")


@query("fmt_pct", "SELECT day, printf('%9.2f%%', accuracy * 100) AS pct FROM metrics_history")
def _fmt_pct(t):
    return B.metrics_history(t).select("day", S.fmt_pct(F.col("accuracy")).alias("pct"))


@query("spark_bar", f"SELECT event_id, {_BAR_SQL.replace('accuracy', 'least(value / 500, 1.0)')} AS bar FROM events")
def _spark_bar(t):
    return t.events.select("event_id", S.spark_bar(F.least(F.col("value") / 500, F.lit(1.0))).alias("bar"))


@query("accuracy_trend", """
    SELECT CAST(date_trunc('second', ts) AS TIMESTAMP) AS seen_at, value AS accuracy FROM events WHERE event_type <> 'error'""")
def _trend(t):
    seen = t.events.select("ts", F.when(F.col("event_type") != "error", F.col("value")).alias("accuracy"))
    return H.accuracy_trend(seen, "ts").select(F.col("seen_at").cast("timestamp_ntz").alias("seen_at"), "accuracy")


# One monitoring cycle per event type and twenty minutes; drift where the mean value is high.
def monitoring_cycles(t):
    seconds = F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + (
        F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts"))
    return t.events.groupBy(F.col("event_type").alias("model_id"), (F.floor(seconds / 1200) * 1200).alias("at")).agg(
        (F.avg("value") > 60).alias("any_drift"))


add_view("cycles", """
    SELECT event_type AS model_id, CAST(floor(epoch(ts) / 1200) * 1200 AS BIGINT) AS "at", AVG(value) > 60 AS any_drift
    FROM events GROUP BY 1, 2""")
add_view("fired", """
    SELECT model_id, MIN("at") AS "at" FROM cycles WHERE any_drift GROUP BY model_id
    UNION ALL
    SELECT f.model_id, (SELECT MIN(c."at") FROM cycles c WHERE c.any_drift AND c.model_id = f.model_id AND c."at" >= f."at" + 3600)
    FROM fired f WHERE f."at" IS NOT NULL""")


@query("retrain_decision", """
    SELECT c.model_id, c."at", c.any_drift, CASE WHEN NOT c.any_drift THEN 'model_stable'
           WHEN f."at" IS NULL THEN 'cool_down_active' ELSE 'retraining_triggered' END AS decision
    FROM cycles c LEFT JOIN fired f ON c.model_id = f.model_id AND c."at" = f."at" """)
def _retrain(t):
    return H.retrain_decisions(monitoring_cycles(t))


@query("length_guard", """
    SELECT CASE WHEN l.doc_id IS NULL THEN 'prediction only' WHEN d.doc_id IS NULL THEN 'actual only' ELSE 'both' END AS side, COUNT(*) AS n
    FROM (SELECT doc_id FROM documents WHERE n_chars > 100) d FULL JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def _length_guard(t):
    """Predictions exist for long documents, actual values for labelled ones: what each lacks is counted."""
    predicted = t.documents.where("n_chars > 100").select("doc_id")
    return C.coverage(predicted, t.labels.select("doc_id"), "doc_id")


@query("label_excluded", """
    SELECT feature, n1::BIGINT AS baseline_rows, n2::BIGINT AS current_rows FROM ks_full""")
def _label_excluded(t):
    tx = B.transactions(t).select(*_FEATURES, "label", "side")
    before, now = tx.where("side = 'baseline'"), tx.where("side = 'current'")
    names = D.common_numeric_columns(before, now, "label")
    sides = tx.groupBy("side").agg(*[F.count(c).alias(c) for c in names])
    wide = sides.select("side", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in names])))
    return wide.groupBy("feature").agg(
        F.sum(F.when(F.col("side") == "baseline", F.col("n"))).alias("baseline_rows"),
        F.sum(F.when(F.col("side") == "current", F.col("n"))).alias("current_rows"))
