"""Onboarding and benefits queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.operators import people as H
from beaconry.plans.oracle_views import add_view
from beaconry.plans.registry import query
from beaconry.sources import bindings as B

AS_OF = "2024-02-15"


def _b(x):
    return "TRUE" if x else "FALSE"


_TEMPLATES = ", ".join(
    f"({i}, '{r}', '{k}', '{c}', '{o}', {d}, {_b(q)}, '{m}')" for i, (r, k, c, o, d, q, m) in enumerate(H.TEMPLATES))
_ROLE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(role), '{w}')" for w in words) + f" THEN '{key}'" for key, words in H.ROLE_WORDS
) + " ELSE 'other' END"

add_view("templates", f"""
    SELECT v.*, coalesce(p_name, task_id) AS title
    FROM (VALUES {_TEMPLATES}) v(place, role_key, task_id, category, owner, due_day, required, milestone)
    LEFT JOIN part ON p_partkey = place + 1""")
add_view("plan_rows", f"""
    SELECT e.employee_id, t.task_id, t.place, t.category, t.owner, t.title, t.milestone, t.required, t.due_day,
           start_date + CAST(CASE WHEN due_day < 0 THEN due_day ELSE greatest(due_day, 1) END AS INT) AS due_date
    FROM (SELECT *, {_ROLE} AS rk FROM employees) e JOIN templates t ON t.role_key = 'base' OR t.role_key = e.rk
         OR (t.role_key = 'manager' AND e.level IN ('manager', 'director', 'vp', 'c_level'))""")
# Task events made from orders: each order of a customer touches one template task.
add_view("task_events", f"""
    SELECT o_custkey AS employee_id, t.task_id, o_orderdate AS seen,
           CASE o_orderkey % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'in_progress' ELSE 'completed' END AS status,
           'order ' || o_orderkey AS note
    FROM orders JOIN templates t ON t.place = o_orderkey % {len(H.TEMPLATES)}""")
add_view("tracked", """
    WITH u AS (SELECT employee_id, task_id, arg_max({'s': status, 'n': note, 'a': seen}, {'a': seen, 's': status}) AS u
               FROM task_events GROUP BY 1, 2)
    SELECT p.*, coalesce(u.s, 'pending') AS status, CASE WHEN u.s = 'completed' THEN u.a END AS completed_at,
           CASE WHEN u.s = 'blocked' THEN u.n END AS blocked_reason
    FROM plan_rows p LEFT JOIN u USING (employee_id, task_id)""")


def task_updates(t):
    tasks = H.template_table(t.spark).select("place", "task_id")
    k = F.col("o_orderkey") % 4
    return t.orders.withColumn("place", (F.col("o_orderkey") % len(H.TEMPLATES)).cast("int")).join(F.broadcast(tasks), "place").select(
        F.col("o_custkey").alias("employee_id"), "task_id", F.col("o_orderdate").alias("at"),
        F.when(k == 0, "blocked").when(k == 1, "in_progress").otherwise("completed").alias("status"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("note"))


def titled(t):
    """Tasks worded by the names of parts: any table of titles will do."""
    ids = H.template_table(t.spark).select("task_id", (F.col("place") + 1).cast("bigint").alias("p_partkey"))
    return t.part.join(F.broadcast(ids), "p_partkey").select("task_id", F.col("p_name").alias("title"))


def tracked(t):
    return H.apply_updates(H.plans(B.employees(t), titles=titled(t)), task_updates(t))


@query("normalise_role", f"SELECT employee_id, {_ROLE} AS role_key FROM employees")
def _role(t):
    return B.employees(t).select("employee_id", H.normalise_role(F.col("role")).alias("role_key"))


@query("onb_plan", "SELECT * FROM plan_rows")
def _plan(t):
    return H.plans(B.employees(t), titles=titled(t))


@query("onb_update", "SELECT employee_id, task_id, status, completed_at, blocked_reason FROM tracked")
def _update(t):
    return tracked(t).select("employee_id", "task_id", "status", "completed_at", "blocked_reason")


@query("onb_overdue", f"SELECT employee_id, task_id, due_date FROM tracked WHERE status = 'pending' AND due_date < DATE '{AS_OF}'")
def _overdue(t):
    return H.overdue(tracked(t), AS_OF).select("employee_id", "task_id", "due_date")


@query("onb_status", f"""
    SELECT employee_id, COUNT(*) AS total, round_even(SUM((status = 'completed')::INT) / COUNT(*) * 100, 1) AS completion_pct,
           SUM((status = 'completed')::INT)::BIGINT AS completed, SUM((status = 'pending')::INT)::BIGINT AS pending,
           SUM((status = 'in_progress')::INT)::BIGINT AS in_progress, SUM((status = 'blocked')::INT)::BIGINT AS blocked,
           SUM((status = 'pending' AND due_date < DATE '{AS_OF}')::INT)::BIGINT AS overdue FROM tracked GROUP BY 1""")
def _status(t):
    return H.status_counts(tracked(t), AS_OF)


@query("onb_next", """
    SELECT employee_id, task_id, due_date, CAST(row_number() OVER (PARTITION BY employee_id ORDER BY due_date, place) AS INT) AS next_no
    FROM tracked WHERE status = 'pending' QUALIFY next_no <= 5""")
def _next(t):
    return H.next_tasks(tracked(t)).select("employee_id", "task_id", "due_date", "next_no")


@query("onb_milestones", """
    SELECT employee_id, milestone, COUNT(*) AS total, SUM((status = 'completed')::INT)::BIGINT AS completed,
           round_even(SUM((status = 'completed')::INT) / COUNT(*) * 100, 1) AS completion_pct FROM tracked GROUP BY 1, 2""")
def _milestones(t):
    return H.milestones(tracked(t))


@query("onb_dashboard", f"""
    WITH x AS (SELECT *, status = 'pending' AND due_date < DATE '{AS_OF}' AS late, status = 'blocked' AS stuck FROM tracked),
         r AS (SELECT *, row_number() OVER (PARTITION BY employee_id, late, stuck ORDER BY due_date, place) AS rn FROM x),
         d AS (SELECT employee_id, round_even(SUM((status = 'completed')::INT) / COUNT(*) * 100, 1) AS completion_pct,
           SUM(late::INT)::BIGINT AS overdue_count, SUM(stuck::INT)::BIGINT AS blocked_count,
           coalesce(string_agg(CASE WHEN late AND rn <= 3 THEN title END, '; ' ORDER BY due_date, place), '') AS overdue_titles,
           coalesce(string_agg(CASE WHEN stuck AND rn <= 3 THEN title END, '; ' ORDER BY due_date, place), '') AS blocked_titles,
           SUM(late::INT) > 0 OR SUM(stuck::INT) > 0 AS needs_attention FROM r GROUP BY 1)
    SELECT *, COUNT(*) OVER () AS employees, (SUM(needs_attention::INT) OVER ())::BIGINT AS employees_needing_attention,
           CASE WHEN needs_attention THEN 0 ELSE 1 END AS place FROM d""")
def _dashboard(t):
    return H.dashboard(tracked(t), AS_OF)


_FTE = "CASE employment_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in H.FTE.items()) + " ELSE 1.0::DOUBLE END"


def _pto_sql(as_of):
    return f"""
    WITH m AS (SELECT *, {_FTE} AS fte, greatest(start_date, date_trunc('year', DATE '{as_of}')::DATE) AS s FROM employees),
         a AS (SELECT *, least(1.75::DOUBLE * fte * greatest(0, (year(DATE '{as_of}') - year(s)) * 12 + month(DATE '{as_of}') - month(s)),
                               21.0::DOUBLE * fte) AS accrued FROM m),
         r AS (SELECT *, greatest(accrued - pto_used, 0) AS remaining, make_date(year(DATE '{as_of}') + 1, 1, 1) - DATE '{as_of}' AS days FROM a)
    SELECT employee_id, round_even(accrued, 1) AS accrued_days, round_even(remaining, 1) AS remaining_days, CAST(days AS INT) AS days_until_reset,
           round_even(CASE WHEN remaining > 5 AND days < 60 THEN remaining - 5 ELSE 0 END, 1) AS forfeited_days FROM r"""


def _pto(t, as_of):
    staff = B.employees(t).withColumnRenamed("start_date", "hire_date")
    return H.pto_balance(staff, as_of).select(
        "employee_id", "accrued_days", "remaining_days", "days_until_reset", "forfeited_days")


@query("pto_balance", _pto_sql("2024-07-15"))
def _pto_mid(t):
    return _pto(t, "2024-07-15")


@query("pto_balance_year_end", _pto_sql("2024-12-01"))
def _pto_end(t):
    return _pto(t, "2024-12-01")


_MATCH_SQL = """
    WITH m AS (SELECT *, least(salary * contribution_pct / 100, 23500) AS own,
                      salary * least(contribution_pct, 3) / 100 + salary * greatest(least(contribution_pct - 3, 2), 0) / 100 * 0.5 AS mt FROM employees)
    SELECT employee_id, round(own, 2) AS employee_contribution, round(mt, 2) AS employer_match, round(own + mt, 2) AS total_contribution,
           round(mt / greatest(own, 1) * 100, 1) AS effective_match_rate,
           CASE WHEN contribution_pct < 5 THEN 'contribute at least 5% to get the full match' ELSE 'full match reached' END AS tip FROM m"""


@query("retirement_match", _MATCH_SQL)
def _match(t):
    return H.retirement_match(B.employees(t)).select(
        "employee_id", "employee_contribution", "employer_match", "total_contribution", "effective_match_rate", "tip")


_PLANS = ", ".join(f"('{p}', '{c}', {a}, {b}, {d}, {o}, {y}, {_b(h)})" for p, c, a, b, d, o, y, h in H.HEALTH_PLANS)


@query("health_cost", f"""
    WITH c AS (SELECT * FROM (VALUES {_PLANS}) v(plan_name, coverage_tier, er, ee, ded, oop, cp, hsa)),
         k AS (SELECT DISTINCT plan_name, hsa FROM c)
    SELECT employee_id, plan_name, coverage_tier, CASE WHEN k.hsa IS NULL THEN 'unknown plan ' || plan_name END AS error,
           CASE WHEN k.hsa IS NOT NULL THEN coalesce(ee, 0)::DOUBLE END AS employee_monthly_cost,
           CASE WHEN k.hsa IS NOT NULL THEN coalesce(er, 0)::DOUBLE END AS employer_monthly_cost,
           CASE WHEN k.hsa IS NOT NULL THEN coalesce(ee, 0)::DOUBLE * 12 END AS annual_employee_cost,
           ded::DOUBLE AS deductible, oop::DOUBLE AS oop_max, cp::DOUBLE AS copay, k.hsa AS hsa_eligible
    FROM employees LEFT JOIN c USING (plan_name, coverage_tier) LEFT JOIN k USING (plan_name)""")
def _health(t):
    return H.health_cost(B.employees(t).select("employee_id", "plan_name", "coverage_tier"))


@query("benefits_summary", f"""
    WITH p AS ({_pto_sql('2024-07-15')}), m AS ({_MATCH_SQL})
    SELECT employee_id, p.remaining_days, m.employer_match, CASE WHEN e.plan_name = 'EPO' THEN 'unknown plan EPO' END AS health_error,
           2 AS misc_items FROM employees e JOIN p USING (employee_id) JOIN m USING (employee_id)""")
def _benefits(t):
    staff = B.employees(t).withColumnRenamed("start_date", "hire_date")
    return H.benefits_summary(staff, "2024-07-15", {"desk": "height adjustable", "lunch": "in house"}).select(
        "employee_id", F.col("pto.remaining_days").alias("remaining_days"), F.col("retirement.employer_match").alias("employer_match"),
        F.col("health.error").alias("health_error"), F.size("misc").alias("misc_items"))
