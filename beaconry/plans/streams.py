"""Stream queries: each runs the available input to its end and must equal the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.operators import assistant as A
from beaconry.operators import drift as D
from beaconry.operators import kpi as K
from beaconry.operators import scorecard as C
from beaconry.plans.oracle_views import add_view
from beaconry.plans.registry import query
from beaconry.plans.scans import metric_records
from beaconry.session import work_path
from beaconry.settings import DEFAULTS
from beaconry.sources import readers, sinks
from beaconry.streaming import flows, runner, state


def _events(t):
    return runner.read_stream(t.spark, t.path("events"))


@query("st_usage", "SELECT CAST(ts AS DATE) AS day, tenant_id, COUNT(*) AS calls FROM requests GROUP BY 1, 2")
def _usage(t):
    requests = _events(t).select("ts", F.concat(F.lit("tenant_"), F.col("user_id").cast("string")).alias("tenant_id"))
    return runner.newest(runner.run(flows.daily_usage(requests), "usage", "update"), ["day", "tenant_id"])


@query("st_usage_closed", """
    WITH d AS (SELECT CAST(ts AS DATE) AS day, tenant_id, COUNT(*) AS calls FROM requests GROUP BY 1, 2)
    SELECT * FROM d WHERE day + 1 <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)""")
def _usage_closed(t):
    requests = _events(t).select("ts", F.concat(F.lit("tenant_"), F.col("user_id").cast("string")).alias("tenant_id"))
    return runner.run(flows.daily_usage(requests), "closed").drop("batch_id")


@query("st_scorecard", """
    WITH p AS (SELECT CAST(ts AS DATE) AS day, (event_type = 'error')::INT AS a, (value > 60)::INT AS p FROM events),
         l AS (SELECT DISTINCT day, unnest([a, p]) AS label FROM p),
         s AS (SELECT l.day, l.label, SUM((a = label AND p = label)::INT) AS tp, SUM((a = label)::INT) AS sup, SUM((p = label)::INT) AS pre
               FROM l JOIN p USING (day) GROUP BY 1, 2),
         c AS (SELECT *, CASE WHEN pre = 0 THEN 0 ELSE tp / pre END AS pr, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS rc,
                      CASE WHEN sup + pre = 0 THEN 0 ELSE 2 * tp / (sup + pre) END AS f FROM s)
    SELECT day, round(SUM(tp) / SUM(sup), 4) AS accuracy, round(AVG(pr), 4) AS "precision", round(AVG(rc), 4) AS recall,
           round(AVG(f), 4) AS f1, SUM(sup)::BIGINT AS total_predictions FROM c GROUP BY 1""")
def _scorecard(t):
    scored = _events(t).select("ts", (F.col("event_type") == "error").cast("int").alias("actual"),
                               (F.col("value") > 60).cast("int").alias("prediction"))
    counts = runner.newest(runner.run(flows.daily_confusion(scored), "confusion", "update"), ["day", "actual", "prediction"])
    return C.scorecard_from_counts(counts, "day")


@query("st_drift", """
    WITH n AS (SELECT value AS v, SUM((ts < TIMESTAMP '2024-01-16')::INT) AS n1, SUM((ts >= TIMESTAMP '2024-01-16')::INT) AS n2 FROM events GROUP BY 1),
         c AS (SELECT SUM(n1) OVER w AS c1, SUM(n2) OVER w AS c2, SUM(n1) OVER () AS t1, SUM(n2) OVER () AS t2 FROM n WINDOW w AS (ORDER BY v)),
         d AS (SELECT MAX(abs(c1::DOUBLE / t1 - c2::DOUBLE / t2)) AS d, MAX(t1)::DOUBLE AS n1, MAX(t2)::DOUBLE AS n2 FROM c),
         l AS (SELECT *, d * sqrt(n1 * n2 / (n1 + n2)) AS lam FROM d),
         p AS (SELECT l.d, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * (SELECT SUM((CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END)
                      * exp(-2.0 * k * k * lam * lam)) FROM generate_series(1, 100) g(k)))) END::DOUBLE AS p FROM l)
    SELECT 'value' AS feature, round(d, 6) AS ks_statistic, round(p, 6) AS p_value, p < 0.05 AS drift_detected FROM p""")
def _drift(t):
    """The newest counts of values of every day, closed or still open, against the counts of the static baseline."""
    split = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    baseline = t.events.where(F.col("ts") < split).groupBy("value").agg(F.count("*").alias("n"))
    counts = runner.run(flows.value_counts(_events(t).where(F.col("ts") >= split)), "drift", "update")
    current = runner.newest(counts, ["day", "value"])
    return D.ks_from_counts(baseline, current, "value", "n")


add_view("event_cycles", "SELECT event_id, event_type AS model_id, CAST(floor(epoch(ts)) AS BIGINT) AS seen, value > 60 AS drift FROM events")
add_view("event_fired", """
    SELECT model_id, MIN(seen) AS seen FROM event_cycles WHERE drift GROUP BY model_id
    UNION ALL
    SELECT f.model_id, (SELECT MIN(c.seen) FROM event_cycles c WHERE c.drift AND c.model_id = f.model_id AND c.seen >= f.seen + 3600)
    FROM event_fired f WHERE f.seen IS NOT NULL""")


@query("st_cooldown", """
    WITH f AS (SELECT c.model_id, MIN(c.event_id) AS event_id FROM event_cycles c JOIN event_fired f ON c.model_id = f.model_id AND c.seen = f.seen
               WHERE c.drift GROUP BY c.model_id, c.seen)
    SELECT c.model_id, c.event_id AS cycle_id, CASE WHEN NOT c.drift THEN 'model_stable' WHEN f.event_id IS NULL THEN 'cool_down_active'
           ELSE 'retraining_triggered' END AS decision
    FROM event_cycles c LEFT JOIN f ON c.event_id = f.event_id""")
def _cooldown(t):
    cycles = _events(t).select(
        F.col("event_type").alias("model_id"), F.col("event_id").alias("cycle_id"),
        F.unix_seconds(runner.utc_instant(F.col("ts"))).alias("at"), (F.col("value") > 60).alias("any_drift"))
    return state.cooldown_decisions(cycles).select("model_id", "cycle_id", "decision")


@query("st_conversation", f"""
    WITH c AS (SELECT conv_id, MAX(turn) AS cleared FROM conversations WHERE role = 'system' GROUP BY 1)
    SELECT i.conv_id, turn, CAST(row_number() OVER (PARTITION BY i.conv_id ORDER BY turn DESC) AS INT) AS age, question
    FROM intents i LEFT JOIN c ON c.conv_id = i.conv_id
    WHERE topic IS NULL AND i.conv_id >= 0 AND (cleared IS NULL OR turn > cleared) QUALIFY age <= {DEFAULTS.memory_turns}""")
def _conversation(t):
    """A system turn clears what was said before it."""
    turns = runner.read_stream(t.spark, t.path("conversations")).where("role IN ('user', 'system')").select(
        "conv_id", "turn", F.col("text").alias("question"),
        A.sensitive_topic(F.col("text")).isNull().alias("answered"), (F.col("role") == "system").alias("clears"))
    with runner.rocksdb_state(t.spark, expiring=True):
        out = runner.run(state.conversation_memory(turns), "memory", "update")
    return runner.newest(out, ["conv_id", "age"]).where("turn IS NOT NULL")


add_view("sliding", """
    SELECT CAST(d.day + g.k::INT AS DATE) AS day, SUM(revenue) AS revenue, SUM(orders) AS orders, SUM(visits) AS visits
    FROM daily_kpi d, generate_series(1, 7) g(k) WHERE d.day + g.k::INT <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1""")


@query("st_kpi", """
    WITH l AS (SELECT day, unnest([{'m': 'revenue', 'v': CAST(revenue AS DOUBLE)}, {'m': 'orders', 'v': CAST(orders AS DOUBLE)},
                                   {'m': 'conversion', 'v': CAST(orders AS DOUBLE) / nullif(visits, 0)}]) AS r FROM sliding),
         s AS (SELECT r.m AS metric_name, day, r.v AS v, AVG(r.v) OVER w AS m, stddev_samp(r.v) OVER w AS sd FROM l WHERE r.v IS NOT NULL
               WINDOW w AS (PARTITION BY r.m ORDER BY day ROWS UNBOUNDED PRECEDING))
    SELECT metric_name, day, round(v, 6) AS value, round((v - m) / nullif(sd, 0), 6) AS z_score,
           coalesce(abs((v - m) / nullif(sd, 0)) > 3, FALSE) AS is_anomaly FROM s""")
def _kpi(t):
    """Sliding windows as they close, each against the moments of its metric so far."""
    closed = K.to_history(flows.sliding_kpis(_events(t)))
    with runner.rocksdb_state(t.spark):
        out = runner.run(state.running_z_scores(closed), "kpis")
    return out.select("metric_name", "day", F.round("value", 6).alias("value"), F.round("z_score", 6).alias("z_score"), "is_anomaly")


@query("st_late", """
    SELECT SUM((ts >= TIMESTAMP '2024-01-10')::INT)::BIGINT AS accepted, SUM((ts < TIMESTAMP '2024-01-10')::INT)::BIGINT AS late FROM events""")
def _late(t):
    """The first days arrive only after the watermark has passed them."""
    feed, late, out, checkpoint = (work_path(t.spark, k) for k in ("feed", "late", "once", "once-state"))
    old = F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    for part in (~old, old):
        t.events.where(part).write.mode("append").parquet(feed)
        stream = t.spark.readStream.schema(t.events.schema).parquet(feed)
        rows = runner.run(flows.once(stream, "event_id"), "once", out=out, checkpoint=checkpoint, late=late)
    dropped = t.spark.read.parquet(late).agg(F.sum("dropped").alias("late"))
    return rows.agg(F.count("*").alias("accepted")).crossJoin(dropped)  # one row each


_REPEATS = """
    SELECT 'tenant_' || (user_id % 5) AS tenant_id, sha256(event_type) AS request, s * 900 AS from_second, s * 900 + 3600 AS to_second, COUNT(*) AS n
    FROM (SELECT *, unnest([floor(epoch(ts) / 900)::BIGINT - 3, floor(epoch(ts) / 900)::BIGINT - 2,
                            floor(epoch(ts) / 900)::BIGINT - 1, floor(epoch(ts) / 900)::BIGINT]) AS s FROM events) GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3"""


def _by_tenant(events):
    return events.select("ts", "event_type", F.concat(F.lit("tenant_"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"))


@query("rep_attack", _REPEATS)
def _repeats(t):
    return flows.repetitions(_by_tenant(t.events), ["event_type"], "1 hour", "15 minutes", 3)


@query("st_rep_attack", f"SELECT * FROM ({_REPEATS}) WHERE to_second <= (SELECT epoch(MAX(ts) - INTERVAL 1 HOUR) FROM events)")
def _stream_repeats(t):
    return runner.run(flows.repetitions(_by_tenant(_events(t)), ["event_type"], "1 hour", "15 minutes", 3), "repeats").drop("batch_id")


@query("st_metrics_tail", """
    SELECT CAST(day AS VARCHAR) AS "timestamp", round(accuracy, 6) AS accuracy, total_predictions FROM metrics_history""")
def _tail(t):
    """The metric log is written and followed as a stream."""
    log = work_path(t.spark, "log")
    sinks.append_metrics(metric_records(t), log)
    tail = t.spark.readStream.schema(readers.METRICS_SCHEMA + ", archive_id string").json(log)
    return runner.run(tail, "tail").select(
        "timestamp", F.round("metrics.accuracy", 6).alias("accuracy"), "metrics.total_predictions")
