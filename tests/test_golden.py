"""Values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from beaconry.functions import scalars as S
from beaconry.operators import assistant, drift, finance, history, people, reports, retrieval, scorecard, sourcing, tenants
from beaconry.operators import profile as P
from beaconry.settings import Settings


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def value(frame, expr):
    return one(frame("x int", (1,)).select(expr.alias("v")))["v"]


def test_settings_are_checked():
    assert Settings().accuracy_threshold == 0.85
    for bad in ({"monitor_interval_seconds": 5}, {"drift_p_value": 0.0}, {"drift_p_value": 1.0}, {"accuracy_threshold": 1.5}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert Settings.from_env({"BEACONRY_DRIFT_P_VALUE": "0.01"}).drift_p_value == 0.01


def test_invoices(frame):
    rows = {r["tenant_id"]: r["amount"] for r in tenants.invoices(frame("tenant_id string, calls bigint", ("a", 100), ("b", 50))).collect()}
    assert rows == {"a": 0.2, "b": 0.1, "ALL": 0.3}
    assert value(frame, tenants.tiered_price(F.lit(150_000))) == 260.0


def test_usage_refuses_small_counts(frame):
    assert one(tenants.usage(frame("tenant_id string, count int", ("a", 3), ("a", 0)), "tenant_id"))["calls"] == 3


def test_drift_of_a_table_with_itself_and_shifted(frame):
    same = frame("x double, y double", *[(float(i), float(i % 7)) for i in range(200)])
    for r in drift.ks_drift(same, same).collect():
        assert (r["ks_statistic"], r["p_value"], r["drift_detected"]) == (0.0, 1.0, False)
    moved = same.withColumn("x", F.col("x") * 3)
    found = {r["feature"]: r["drift_detected"] for r in drift.ks_drift(same, moved).collect()}
    assert found == {"x": True, "y": False}
    back = {r["feature"]: r["ks_statistic"] for r in drift.ks_drift(moved, same).collect()}
    there = {r["feature"]: r["ks_statistic"] for r in drift.ks_drift(same, moved).collect()}
    assert back == there
    with pytest.raises(ValueError):
        drift.ks_drift(same, frame("z string", ("a",)))
    assert drift.common_numeric_columns(same, moved, "y") == ["x"]


def test_p_value_series(frame):
    assert value(frame, drift.ks_p_value(F.lit(1.36), F.lit(2.0), F.lit(2.0))) == pytest.approx(0.049486, abs=1e-6)


def test_scorecard_all_wrong_and_perfect(frame):
    wrong = scorecard.scorecard(frame("actual int, prediction int", *[(1, 0)] * 4))
    r = one(wrong)
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (0, 0, 0, 0)
    assert scorecard.accuracy_alerts(wrong).count() == 1
    good = scorecard.scorecard(frame("actual int, prediction int", (1, 1), (0, 0)))
    assert one(good)["accuracy"] == 1.0 and scorecard.accuracy_alerts(good).count() == 0
    with pytest.raises(ValueError):
        scorecard.scorecard(frame("actual int", (1,)))
    with pytest.raises(ValueError):
        scorecard.align(frame("k int, prediction int", (1, 1)), frame("k int, actual int", (2, 1)), "k")


def test_retrain_decision(frame):
    cycles = frame("model_id string, at bigint, any_drift boolean",
                   ("m", 0, False), ("m", 10, True), ("m", 20, True), ("m", 3609, True), ("m", 3610, True), ("m", 3620, True))
    got = [r["decision"] for r in history.retrain_decisions(cycles).orderBy("at").collect()]
    assert got == ["model_stable", "retraining_triggered", "cool_down_active", "cool_down_active",
                   "retraining_triggered", "cool_down_active"]
    failing = frame("model_id string, at bigint, any_drift boolean, failed boolean",
                    ("m", 10, True, True), ("m", 20, True, False), ("m", 30, True, False))
    got = [r["decision"] for r in history.retrain_decisions(failing).orderBy("at").collect()]
    assert got == ["error:retraining failed", "retraining_triggered", "cool_down_active"]


STAFF = "employee_id bigint, hire_date string, pto_used double, employment_type string"


@pytest.mark.parametrize(("as_of", "months", "accrued", "remaining", "days", "lost"), [
    ("2024-07-15", 6, 10.5, 5.5, 170, 0.0), ("2024-12-01", 11, 19.2, 14.2, 31, 9.2)])
def test_pto(frame, as_of, months, accrued, remaining, days, lost):
    staff = frame(STAFF, (1, "2023-06-01", 5.0, "full_time")).withColumn("hire_date", F.col("hire_date").cast("date"))
    r = one(people.pto_balance(staff, as_of))
    assert (r["months"], r["accrued_days"], r["remaining_days"], r["days_until_reset"], r["forfeited_days"]) == (
        months, accrued, remaining, days, lost)


@pytest.mark.parametrize(("pct", "salary", "own", "match"), [(6, 100_000, 6000, 4000), (5, 80_000, 4000, 3200), (2, 100_000, 2000, 2000)])
def test_match(frame, pct, salary, own, match):
    r = one(people.retirement_match(frame("contribution_pct double, salary double", (float(pct), float(salary)))))
    assert (r["employee_contribution"], r["employer_match"]) == (own, match)
    if pct == 6:
        assert r["effective_match_rate"] == 66.7
    assert ("at least 5%" in r["tip"]) == (pct < 5)


def test_onboarding_plan(frame):
    staff = frame("employee_id bigint, role string, level string, start_date string",
                  (1, "Engineering Manager", "individual_contributor", "2024-03-04")).withColumn("start_date", F.col("start_date").cast("date"))
    tasks = people.plans(staff).orderBy("due_date", "place").collect()
    assert len(tasks) == 20 and str(tasks[0]["due_date"]) == "2024-02-26"
    assert {str(t["due_date"]) for t in tasks if t["due_day"] == 1} == {"2024-03-05"}
    custom = frame("employee_id bigint, place int, task_id string, category string, owner string, due_day int, required boolean, "
                   "milestone string, title string", (1, 0, "own_01", "custom", "HR", 2, True, "week_1", "Extra"),
                   (1, 1, "d1_01", "custom", "HR", 2, True, "week_1", "Repeated id"))
    more = {t["task_id"]: t["title"] for t in people.plans(staff, custom).collect()}
    assert len(more) == 21 and more["d1_01"] == "d1_01"


def test_vendor_rules(frame):
    vendors = frame("vendor_id bigint, vendor_name string, category string, total_spend double, total_volume double, average_price double",
                    (1, "V", "c", 1_000_000.0, 500.0, 120.0), (2, "W", "none", 10.0, 1.0, 1.0))
    market = frame("category string, market_price double, high_volume_threshold double", ("c", 100.0, 400.0))
    rows = {r["vendor_id"]: r for r in sourcing.price_against_market(vendors, market).collect()}
    assert (rows[1]["negotiation_score"], rows[1]["price_savings"]) == (35.0, 200_000.0)
    assert rows[2]["negotiation_score"] is None and rows[2]["price_savings"] == 0.0
    contracts = frame("vendor_id bigint, expiry_date string, payment_terms_days int", (1, "2024-02-15", 0), (2, "2023-12-27", 60)).withColumn(
        "expiry_date", F.col("expiry_date").cast("date"))
    renewals = {r["vendor_id"]: (r["near_renewal"], r["renewal_priority"]) for r in sourcing.contract_renewal(contracts, "2024-01-01").collect()}
    assert renewals == {1: (True, "MEDIUM"), 2: (False, "HIGH")}
    opps = sourcing.negotiation_opportunities(vendors, market, contracts, frame("vendor_id bigint, amount double", (1, 10.0)), "2024-01-01")
    r = one(opps)
    assert r["savings_potential"] == pytest.approx(380_000.0)
    assert value(frame, sourcing.priority_of(F.lit(380_000.0))) == "critical"


def series(frame, *ys):
    return frame("series string, t int, y double, idx int", *[("s", i, float(y), i) for i, y in enumerate(ys)])


def test_finance(frame):
    s = series(frame, 10, 20, 30)
    got = [r["smoothed"] for r in finance.exponential_smoothing(s).orderBy("idx").collect()]
    assert got == pytest.approx([10, 13, 18.1])
    got = [r["forecast"] for r in finance.forecast(s).orderBy("step").collect()]
    assert got == pytest.approx([22.15, 26.2, 30.25])
    r = one(finance.trend_changes(series(frame, 1, 3, 2)))
    assert (r["idx"], r["type"], r["change_ratio"]) == (1, "reversal_down", 1.5)
    wide = frame("t int, revenue double, expenses double, payroll double", (1, 100.0, 85.0, 55.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 0.0))
    kinds = [(r["t"], r["type"]) for r in finance.cash_flow_flags(wide, "t").collect()]
    assert sorted(kinds) == [(1, "high_expense_ratio"), (1, "high_payroll_ratio"), (1, "negative_cash_flow"),
                             (2, "high_expense_ratio"), (2, "negative_cash_flow")]
    base = frame("revenue double, expenses double, payroll double", (100.0, 50.0, 20.0))
    nets = {r["scenario"]: (r["net_income"], r["net_spread"]) for r in finance.scenarios(base).collect()}
    assert {k: v[0] for k, v in nets.items()} == pytest.approx({"best": 47.5, "likely": 30.0, "worst": 15.0})
    assert nets["best"][1] == pytest.approx(32.5)
    assert finance.outliers(series(frame, 5, 5, 5)).count() == 0


def test_long_smoothing_equals_a_loop(frame):
    ys = [((i * 7919) % 1000) / 10 for i in range(1500)]
    want, last = [], None
    for y in ys:
        last = y if last is None else 0.3 * y + 0.7 * last
        want.append(last)
    got = [r["smoothed"] for r in finance.exponential_smoothing(series(frame, *ys)).orderBy("idx").collect()]
    assert got == pytest.approx(want, rel=1e-12)


def test_scores_and_text(frame):
    for text, want in (("150", 100), ("-3", 0), ("A+", 0), ("85", 85), ("85.5", 0)):
        assert value(frame, S.score_clamp(F.lit(text))) == want
    assert value(frame, S.sanitize_text(F.lit("""<a href="x">'&'</a>"""), 12)) == "&lt;a href=&"
    assert value(frame, S.sanitize_column_name(F.lit("  a-b c!  "))) == "ab c"
    assert value(frame, S.sanitize_column_name(F.lit("!!"))) == "unnamed_column"
    assert value(frame, S.fmt_pct(F.lit(None).cast("double"))) == "       N/A"
    assert value(frame, S.spark_bar(F.lit(None).cast("double"))) == "?" * 20
    assert P.safe_names(["a!", "a", "a?"]) == {"a!": "a", "a": "a_2", "a?": "a_3"}


def test_report_scores_and_rejections(frame):
    def judged(raw):
        r = one(reports.parse_reports(frame("raw string", (raw,))))
        return r["reject_reason"], r["quality_score"]

    assert judged('{"exec_summary":"x","data_quality":{"score":85.7}}') == (None, 85)
    assert judged('{"exec_summary":"x","data_quality":{"score":"85.5"}}') == (None, 0)
    assert judged('{"exec_summary":"x","data_quality":{"score":true}}') == (None, 1)
    assert judged('{"exec_summary":"x"}') == (None, 0)
    assert judged('{"insights":[]}')[0] == "summary_missing"
    assert judged('{"exec_summary":"x","insights":[{"title":"t","detail":"d","priority":"urgent"}]}')[0] == "bad_insight"
    assert judged("[1]")[0] == "not_an_object" and judged("{")[0] == "malformed" and judged(" ")[0] == "empty"


def test_text(frame):
    assert value(frame, retrieval.hashed_buckets(F.lit("Policy policy"))) == [214]
    long = "x" * 900
    assert value(frame, retrieval.chunk_array(F.lit(long))) == [long]
    assert value(frame, retrieval.chunk_array(F.lit("  \n "))) == []


def test_questions(frame):
    assert value(frame, assistant.intent_of(F.lit("Where is my laptop and badge?"))) == "onboarding"
    assert value(frame, assistant.intent_of(F.lit("zzz"))) == "general"
    assert value(frame, assistant.sensitive_topic(F.lit("He asked about Harassment and my lawyer"))) == "harassment"
    assert value(frame, assistant.sensitive_topic(F.lit("adapt"))) is None


def test_canary_weight_zero_is_stable_and_replays_agree(frame):
    registry = frame("tenant_id string, stable_model string, canary_model string, canary_weight double",
                     ("a", "s", "c", 0.0), ("b", "s", "c", 0.3))
    requests = frame("request_id bigint, tenant_id string", *[(i, "ab"[i % 2]) for i in range(4000)], (9999, "ghost"))
    routed = tenants.route(requests, registry)
    rows = {(r["tenant_id"], r["route"]): r["n"] for r in routed.groupBy("tenant_id", "route").agg(F.count("*").alias("n")).collect()}
    assert rows[("a", "stable")] == 2000 and rows[("ghost", "unknown_tenant")] == 1
    assert abs(rows[("b", "canary")] / 2000 - 0.3) < 3 * (0.3 * 0.7 / 2000) ** 0.5
    assert routed.exceptAll(tenants.route(requests, registry)).isEmpty()
