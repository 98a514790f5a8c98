"""Training, scoring, robustness and isolation-forest queries."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from beaconry.functions.sequences import lookup
from beaconry.operators import outlier_forest as I
from beaconry.operators import robustness as R
from beaconry.operators import training as M
from beaconry.operators.profile import fingerprint
from beaconry.plans.oracle_views import add_view
from beaconry.plans.registry import query
from beaconry.session import shared_folder
from beaconry.settings import DEFAULTS
from beaconry.sources import sinks
from beaconry.sources import bindings as B

_FEATURES = ["transaction_amount", "account_age", "num_transactions", "merchant_risk"]
_KEY = ["l_orderkey", "l_linenumber", *_FEATURES]


def labelled(t, spread=False):
    """Transactions labelled risky where amount times risk is high: a rule a forest can learn. Scoring spreads them."""
    return B.transactions(t, spread).select(
        "l_orderkey", "l_linenumber", *_FEATURES,
        (F.col("transaction_amount") * F.col("merchant_risk") > 2500).cast("int").alias("label"))


def models_folder(t) -> str:
    """Where the models of exactly these rows are published: named by the fingerprint of the labelled table."""
    print_ = fingerprint(labelled(t, spread=True)).first()["fingerprint"]
    return f"{shared_folder(t.spark).rstrip('/')}/models-{print_}"


def trained(t, folder: str | None = None) -> M.Trained:
    """The published model of this data, loaded through the pointer; trained in full and published where there is none.

    ``folder`` is given where it is known already: its name takes a pass over all rows.
    """
    folder = folder or models_folder(t)
    if sinks.current_model(t.spark, folder) is None:
        return M.train_and_publish(labelled(t), "label", _KEY, folder, "v1", features=_FEATURES)  # checked as loaded again
    return M.load(t.spark, folder)


add_view("labelled", """
    SELECT l_orderkey, l_linenumber, transaction_amount, account_age, num_transactions, merchant_risk,
           (transaction_amount * merchant_risk > 2500)::INT AS label FROM transactions""")
_GAP = "CASE WHEN l_linenumber = 3 THEN NULL ELSE num_transactions END"


@query("feat_median_impute", f"""
    SELECT label, COUNT(*) AS n, SUM(coalesce({_GAP}, (SELECT median({_GAP}) FROM labelled))) AS total FROM labelled GROUP BY 1""")
def _impute(t):
    gaps = labelled(t).withColumn("num_transactions", F.when(F.col("l_linenumber") != 3, F.col("num_transactions")))
    filled = M.impute(gaps, M.medians(gaps, ["num_transactions"]))
    return filled.groupBy("label").agg(F.count("*").alias("n"), F.sum("num_transactions").alias("total"))


@query("feat_numeric_only", "SELECT 'value' AS feature, COUNT(*) AS n FROM events UNION ALL SELECT 'user_id', COUNT(*) FROM events")
def _numeric_only(t):
    names = M.feature_columns(t.events, "event_id")
    return t.events.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.lit(c) for c in names])).alias("feature"), "n")


@query("feat_derived", """
    WITH f AS (SELECT event_type, COUNT(*) AS n, row_number() OVER (ORDER BY COUNT(*) DESC, event_type) - 1 AS cls FROM events GROUP BY 1)
    SELECT event_type, cls::DOUBLE AS class_index, n, round(SUM(ln(1 + greatest(value, 0))), 4) AS log_total,
           round(SUM(sin(2 * pi() * extract('hour' FROM ts) / 24)), 4) AS sin_total, round(SUM(cos(2 * pi() * extract('hour' FROM ts) / 24)), 4) AS cos_total
    FROM events JOIN f USING (event_type) GROUP BY ALL""")
def _derived(t):
    """Derived features of all events, by the stages that a model is saved with."""
    rows = t.events.select("event_type", "value", F.hour("ts").alias("hour"))
    derived = M.Derived(("value",), (("hour", 24.0),), ("event_type",))
    made = Pipeline(stages=[derived.transformer(), derived.encoders()[0]]).fit(rows).transform(rows)
    return made.groupBy("event_type", F.col("_class0").alias("class_index")).agg(
        F.count("*").alias("n"), F.round(F.sum("_log0"), 4).alias("log_total"),
        F.round(F.sum("_sin0"), 4).alias("sin_total"), F.round(F.sum("_cos0"), 4).alias("cos_total"))


@query("split_stratified", """
    WITH h AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR))) AS r,
                      COUNT(*) OVER (PARTITION BY event_type) AS n, event_id FROM events)
    SELECT event_id, event_type, r <= n - ceil(n * (1 - 0.8::DOUBLE)) AS in_train FROM h""")
def _split(t):
    return M.stratified_split(t.events.select("event_id", "event_type"), "event_type", ["event_id"])


@query("scale_standard", """
    WITH s AS (SELECT AVG(value) AS m, stddev_pop(value) AS sd FROM events)
    SELECT event_id, round((value - m) / sd, 6) AS value FROM events, s""")
def _scale(t):
    rows = t.events.select("event_id", "value")
    return M.standardise(rows, M.scaling(rows, ["value"])).withColumn("value", F.round("value", 6))


@query("class_weights", """
    SELECT label, COUNT(*) AS n, round((SELECT COUNT(*) FROM labelled) / ((SELECT COUNT(DISTINCT label) FROM labelled) * COUNT(*)), 9) AS weight
    FROM labelled GROUP BY 1""")
def _weights(t):
    return M.class_weights(labelled(t), "label").withColumn("weight", F.round("weight", 9))


@query("train_forest")
def _train(t):
    m = trained(t)
    held = M.stratified_split(labelled(t, spread=True), "label", _KEY).where("not in_train")
    return m.score_table(held).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query("quality_gate", """
    WITH noise AS (SELECT *, (md5(l_orderkey || '-' || l_linenumber) < '8')::INT AS coin FROM labelled),
         told AS (SELECT MIN(label) = MAX(label) AS one FROM labelled GROUP BY transaction_amount, account_age, num_transactions, merchant_risk)
    SELECT 'learnable' AS label_kind, (SELECT bool_and(one) FROM told) AS passes, 'v1' AS current_version, COUNT(*) AS records,
           SUM(label)::BIGINT AS positives FROM noise
    UNION ALL SELECT 'random', greatest(AVG(coin), 1 - AVG(coin)) >= 0.85, 'v1', COUNT(*), SUM(coin)::BIGINT FROM noise""")
def _gate(t):
    """A learnable label passes the default threshold and is published; a random one fails, and the pointer stays.

    The forest on the random label has all trees, but of depth 5: a deep one splits noise down to single rows and takes many
    times as long as the learnable one. The SQL expects a pass where the features settle the label, and none for a coin that the
    features know nothing of, unless one of its sides alone reached the threshold.
    """
    folder = models_folder(t)
    good = trained(t, folder)
    text = F.concat_ws("-", "l_orderkey", "l_linenumber")
    noise = labelled(t).withColumn("label", (F.md5(text.cast("binary")) < "8").cast("int"))
    try:
        M.train_and_publish(noise, "label", _KEY, folder, "v2", size=M.ForestSize(depth=5), features=_FEATURES)
        refused = False
    except M.QualityGateError:
        refused = True
    passes = {"learnable": good.card["accuracy"] >= DEFAULTS.accuracy_threshold, "random": not refused}
    current = sinks.current_model(t.spark, folder)["version"]

    def row(kind, df):
        return df.agg(F.lit(kind).alias("label_kind"), F.lit(passes[kind]).alias("passes"), F.lit(current).alias("current_version"),
                      F.count("*").alias("records"), F.sum("label").alias("positives"))

    return row("learnable", labelled(t)).unionByName(row("random", noise))


@query("batch_score")
def _score(t):
    """One row for each record: its key and features, the prediction, the model's version and the time of scoring."""
    records = B.transactions(t, spread=True).select("l_orderkey", "l_linenumber", *_FEATURES)
    return M.batch_score(trained(t), records, "bank_a/fraud_v1.bin", "2024-01-31T00:00:00")


@query("rob_perturb")
def _perturb(t):
    return R.perturbation(trained(t), labelled(t, spread=True))


@query("rob_boundary")
def _boundary(t):
    return R.boundary(trained(t), labelled(t, spread=True), _GRID)


_GRID = {"transaction_amount": 5000.0, "account_age": 200.0, "num_transactions": 5.0, "merchant_risk": 0.02}


@query("rob_extreme", """
    SELECT unnest(['zero', 'huge', 'negative', 'infinite']) AS variant, n AS records, 0::BIGINT AS bad FROM (SELECT COUNT(*) AS n FROM labelled)""")
def _extreme(t):
    return R.extremes(trained(t), labelled(t, spread=True))


@query("rob_schema", f"""
    SELECT unnest({_FEATURES}) AS dropped, TRUE AS refused, 'missing columns: ' || dropped AS reason, n AS records
    FROM (SELECT COUNT(*) AS n FROM labelled)""")
def _schema(t):
    return R.schema_outcomes(trained(t), labelled(t))


@query("rob_repeat", "SELECT COUNT(*) AS records, 0::BIGINT AS unstable FROM labelled")
def _repeat(t):
    return R.repeatable(trained(t), labelled(t, spread=True))


@query("rob_results")
def _results(t):
    return R.results(trained(t), labelled(t, spread=True), _GRID)


# Check outcomes made from events: one suite per user, the event type is the check.
@query("rob_summary", """
    WITH c AS (SELECT user_id, event_type AS test_name, value < 100 AS passed,
                      CASE WHEN value > 200 THEN 3 WHEN value > 150 THEN 2 WHEN value > 120 THEN 1 ELSE 0 END AS o FROM events)
    SELECT user_id, COUNT(*) AS total, SUM(passed::INT)::BIGINT AS n_passed, SUM((NOT passed)::INT)::BIGINT AS n_failed,
           CASE coalesce(MAX(CASE WHEN NOT passed THEN o END), 0) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS overall_risk,
           coalesce(string_agg(DISTINCT CASE WHEN NOT passed THEN test_name END, ',' ORDER BY CASE WHEN NOT passed THEN test_name END), '') AS failed_tests
    FROM c GROUP BY 1""")
def _summary(t):
    v = F.col("value")
    checks = t.events.select(
        "user_id", F.col("event_type").alias("test_name"), (v < 100).alias("passed"),
        F.when(v > 200, "critical").when(v > 150, "high").when(v > 120, "medium").otherwise("low").alias("risk_level"))
    return R.summary(checks, "user_id")


@query("iforest")
def _iforest(t):
    """Price ratios of every order line against the list price of its part."""
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    lines = t.spread("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    priced = lookup(lines, parts, ["l_partkey"], "inner")
    ratios = priced.withColumn(
        "price_ratio", F.col("l_extendedprice") / F.col("l_quantity") / F.col("p_retailprice"))
    return I.detect(ratios, ["price_ratio"], lines.columns).select(
        "l_orderkey", "l_linenumber", "price_ratio", "anomaly_score")
