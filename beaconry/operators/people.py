"""Onboarding plans and benefits for a whole workforce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Role words, task templates (role, id, category, owner, due day, required,
# milestone), benefit rates and plan amounts. Titles of tasks and further benefits are tables of the user.
# ---------------------------------------------------------------------------------------------
ROLE_WORDS = (
    ("engineer", ("engineer", "developer", "swe", "sde", "software")),
    ("manager", ("manager", "director", "vp", "head of", "lead")),
    ("sales", ("sales", "account executive", "ae", "sdr", "bdr")),
    ("finance", ("finance", "accounting", "controller", "analyst")),
)
MANAGER_LEVELS = ("manager", "director", "vp", "c_level")
STATUSES = ("pending", "in_progress", "completed", "skipped", "blocked")
TEMPLATES = (
    ("base", "pre_01", "pre_arrival", "HR", -3, True, "pre_arrival"),
    ("base", "pre_02", "pre_arrival", "HR", -5, True, "pre_arrival"),
    ("base", "pre_03", "pre_arrival", "IT", -7, True, "pre_arrival"),
    ("base", "d1_01", "day_1", "Facilities", 1, True, "day_1"),
    ("base", "d1_02", "day_1", "IT", 1, True, "day_1"),
    ("base", "d1_03", "day_1", "HR", 1, True, "day_1"),
    ("base", "d1_04", "day_1", "Manager", 1, True, "day_1"),
    ("base", "w1_01", "week_1", "IT", 3, True, "week_1"),
    ("base", "w1_02", "week_1", "HR", 5, True, "week_1"),
    ("base", "w1_03", "week_1", "HR", 5, True, "week_1"),
    ("base", "w1_04", "week_1", "Compliance", 7, True, "week_1"),
    ("base", "w1_05", "week_1", "Compliance", 7, True, "week_1"),
    ("base", "m1_01", "month_1", "HR", 30, True, "30_day"),
    ("base", "m1_02", "month_1", "Manager", 30, True, "30_day"),
    ("base", "m1_03", "month_1", "Employee", 30, False, "month_1"),
    ("base", "q1_01", "quarter_1", "Manager", 90, True, "90_day"),
    ("base", "q1_02", "quarter_1", "Employee", 90, True, "90_day"),
    ("engineer", "eng_01", "role_specific", "IT", 7, True, "week_1"),
    ("engineer", "eng_02", "role_specific", "Engineering", 3, True, "week_1"),
    ("engineer", "eng_03", "role_specific", "Engineering", 14, False, "week_2"),
    ("manager", "mgr_01", "role_specific", "HR", 14, True, "week_2"),
    ("manager", "mgr_02", "role_specific", "Manager", 5, True, "week_1"),
    ("manager", "mgr_03", "role_specific", "HR", 30, True, "30_day"),
    ("sales", "sales_01", "role_specific", "Sales Enablement", 14, True, "week_2"),
    ("sales", "sales_02", "role_specific", "IT", 3, True, "week_1"),
    ("finance", "fin_01", "role_specific", "Finance", 7, True, "week_1"),
    ("finance", "fin_02", "role_specific", "IT", 3, True, "week_1"),
)
ACCRUAL_PER_MONTH, MAX_ANNUAL_DAYS, CARRYOVER_DAYS, FORFEIT_WITHIN_DAYS = 1.75, 21.0, 5.0, 60
FTE = {"full_time": 1.0, "part_time_80": 0.8, "part_time_60": 0.6, "part_time_50": 0.5}
MATCH_TIERS = ((3.0, 100.0), (2.0, 50.0))
CONTRIBUTION_LIMIT = 23_500.0
# plan, coverage tier, employer premium, employee premium, deductible, out-of-pocket maximum, copay, HSA eligible
HEALTH_PLANS = (
    ("PPO", "employee_only", 450, 120, 1000, 4000, 25, False),
    ("PPO", "employee_plus_one", 850, 280, 2000, 8000, 25, False),
    ("PPO", "family", 1200, 400, 3000, 12000, 25, False),
    ("HDHP", "employee_only", 500, 60, 2800, 5000, 0, True),
    ("HDHP", "employee_plus_one", 950, 140, 5600, 10000, 0, True),
    ("HDHP", "family", 1350, 200, 5600, 14000, 0, True),
    ("HMO", "employee_only", 480, 80, 500, 3000, 20, False),
    ("HMO", "employee_plus_one", 900, 200, 1000, 6000, 20, False),
    ("HMO", "family", 1280, 320, 1500, 9000, 20, False),
)


def normalise_role(role: Column) -> Column:
    """Template key of a free-text role; the first rule with a hit wins."""
    low = F.lower(role)
    out = F.lit("other")
    for key, words in reversed(ROLE_WORDS):
        hit = None
        for w in words:
            hit = low.contains(w) if hit is None else hit | low.contains(w)
        out = F.when(hit, key).otherwise(out)
    return out


def template_table(spark: SparkSession) -> DataFrame:
    """The fixed templates; a task is titled by its id until titles are given."""
    return spark.createDataFrame(
        [(i, *t, t[1]) for i, t in enumerate(TEMPLATES)],
        "place int, role_key string, task_id string, category string, owner string, due_day int, required boolean, "
        "milestone string, title string")


def plans(employees: DataFrame, custom: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """One row per employee and task. Templates are a fixed small table, so the join is map-only.

    ``titles`` (task_id, title; one row for each id) words the tasks.

    ``custom`` adds tasks (employee_id and the template columns); of two tasks with the same id
    the first in template order stays.
    """
    keys = F.array_distinct(F.array_compact(F.array(
        F.lit("base"), F.nullif(normalise_role(F.col("role")), F.lit("other")),
        F.when(F.col("level").isin(*MANAGER_LEVELS), F.lit("manager")))))
    staff = employees.select("employee_id", "start_date", F.explode(keys).alias("role_key"))
    templates = template_table(employees.sparkSession)
    if titles is not None:
        worded = titles.select("task_id", F.col("title").alias("_title"))
        templates = templates.join(worded, "task_id", "left").withColumn("title", F.coalesce("_title", "title")).select(
            *templates.columns)
    tasks = staff.join(F.broadcast(templates), "role_key")  # as many rows as there are fixed templates
    if custom is not None:
        extra = custom.join(employees.select("employee_id", "start_date"), "employee_id").withColumn("role_key", F.lit("custom"))
        both = tasks.unionByName(extra.withColumn("place", F.col("place") + len(TEMPLATES)))
        row = F.struct(*[c for c in tasks.columns if c not in ("employee_id", "task_id")])
        tasks = both.groupBy("employee_id", "task_id").agg(F.min_by(row, "place").alias("r")).select(
            "employee_id", "task_id", "r.*")
    shift = F.when(F.col("due_day") < 0, F.col("due_day")).otherwise(F.greatest(F.col("due_day"), F.lit(1)))
    return tasks.select(
        "employee_id", "task_id", "place", "category", "owner", "title", "milestone", "required", "due_day",
        F.date_add("start_date", shift).alias("due_date"))


def apply_updates(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Status of every task after an event log (employee_id, task_id, at, status, note); latest wins."""
    newest = updates.where(F.col("status").isin(*STATUSES)).groupBy("employee_id", "task_id").agg(
        F.max_by(F.struct("status", "at", "note"), F.struct("at", "status")).alias("u"))
    return tasks.join(newest, ["employee_id", "task_id"], "left").select(
        *tasks.columns, F.coalesce("u.status", F.lit("pending")).alias("status"),
        F.when(F.col("u.status") == "completed", F.col("u.at")).alias("completed_at"),
        F.when(F.col("u.status") == "blocked", F.col("u.note")).alias("blocked_reason"))


def is_overdue(as_of: str) -> Column:
    return (F.col("status") == "pending") & (F.col("due_date") < F.lit(as_of).cast("date"))


def overdue(tracked: DataFrame, as_of: str) -> DataFrame:
    return tracked.where(is_overdue(as_of))


def status_counts(tracked: DataFrame, as_of: str) -> DataFrame:
    """Share completed and counts per status; a plan has a few dozen tasks at most."""
    done = F.count_if(F.col("status") == "completed")
    return tracked.groupBy("employee_id").agg(
        F.count("*").alias("total"), F.bround(done / F.count("*") * 100, 1).alias("completion_pct"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "pending", "in_progress", "blocked")],
        F.count_if(is_overdue(as_of)).alias("overdue"))


def next_tasks(tracked: DataFrame, n: int = 5) -> DataFrame:
    place = Window.partitionBy("employee_id").orderBy("due_date", "place")
    return tracked.where("status = 'pending'").withColumn("next_no", F.row_number().over(place)).where(F.col("next_no") <= n)


def milestones(tracked: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "completed")
    return tracked.groupBy("employee_id", "milestone").agg(
        F.count("*").alias("total"), done.alias("completed"), F.bround(done / F.count("*") * 100, 1).alias("completion_pct"))


def dashboard(tracked: DataFrame, as_of: str, shown: int = 3) -> DataFrame:
    """Per employee: share completed, overdue and blocked counts, attention flag, the first titles of each kind, the totals
    over all employees, and ``place``, the order of attention first.

    The first titles are ranked rows, so no list is longer than ``shown``.
    """
    late, stuck = is_overdue(as_of), F.col("status") == "blocked"
    per = tracked.groupBy("employee_id").agg(
        F.bround(F.count_if(F.col("status") == "completed") / F.count("*") * 100, 1).alias("completion_pct"),
        F.count_if(late).alias("overdue_count"), F.count_if(stuck).alias("blocked_count"))
    order = Window.partitionBy("employee_id", "_kind").orderBy("due_date", "place")
    kinds = F.when(late, "overdue").when(stuck, "blocked")  # a task has one status
    first = tracked.withColumn("_kind", kinds).where("_kind is not null").withColumn("_r", F.row_number().over(order)).where(
        F.col("_r") <= shown)

    def titles(kind: str) -> Column:
        some = F.sort_array(F.collect_list(F.when(F.col("_kind") == kind, F.struct("_r", "title"))))
        return F.array_join(F.transform(some, lambda x: x["title"]), "; ").alias(f"{kind}_titles")

    texts = first.groupBy("employee_id").agg(titles("overdue"), titles("blocked"))
    needs = (F.col("overdue_count") > 0) | (F.col("blocked_count") > 0)
    rows = per.join(texts, "employee_id", "left").withColumn("needs_attention", needs)
    sums = rows.agg(F.count("*").alias("employees"), F.count_if("needs_attention").alias("employees_needing_attention"))
    return rows.join(F.broadcast(sums)).select(  # one row of totals
        "employee_id", "completion_pct", "overdue_count", "blocked_count", F.coalesce("overdue_titles", F.lit("")).alias("overdue_titles"),
        F.coalesce("blocked_titles", F.lit("")).alias("blocked_titles"), "needs_attention", "employees",
        "employees_needing_attention", F.when(F.col("needs_attention"), 0).otherwise(1).alias("place"))


def pto_balance(staff: DataFrame, as_of: str) -> DataFrame:
    """Leave balance of the year of ``as_of`` (hire_date, pto_used, employment_type)."""
    today = F.lit(as_of).cast("date")
    fte = F.lit(1.0)
    for kind, share in FTE.items():
        fte = F.when(F.col("employment_type") == kind, share).otherwise(fte)
    start = F.greatest(F.col("hire_date"), F.trunc(today, "year"))
    months = F.greatest(F.lit(0), (F.year(today) - F.year(start)) * 12 + F.month(today) - F.month(start))
    reset = F.make_date(F.year(today) + 1, F.lit(1), F.lit(1))
    with_rate = staff.withColumns({"accrual_rate": F.lit(ACCRUAL_PER_MONTH) * fte, "months": months, "_fte": fte})
    accrued = with_rate.withColumn(
        "accrued_days", F.least(F.col("accrual_rate") * F.col("months"), F.lit(MAX_ANNUAL_DAYS) * F.col("_fte")))
    left = accrued.withColumns({
        "remaining_days": F.greatest(F.col("accrued_days") - F.col("pto_used"), F.lit(0.0)),
        "days_until_reset": F.date_diff(reset, today)})
    lost = F.when((F.col("remaining_days") > CARRYOVER_DAYS) & (F.col("days_until_reset") < FORFEIT_WITHIN_DAYS),
                  F.col("remaining_days") - CARRYOVER_DAYS).otherwise(0.0)
    exact = left.withColumn("forfeited_days", lost).drop("_fte")
    # shown to one decimal, halves to the even digit; all is computed before anything is rounded
    return exact.withColumns({c: F.bround(c, 1) for c in ("accrued_days", "pto_used", "remaining_days", "forfeited_days")})


def retirement_match(staff: DataFrame) -> DataFrame:
    """Employer match by tiers; the contribution limit caps the employee's part, not the match."""
    pct, salary = F.col("contribution_pct"), F.col("salary")
    own = F.least(salary * pct / 100, F.lit(CONTRIBUTION_LIMIT))
    match, start = F.lit(0.0), 0.0
    for width, rate in MATCH_TIERS:
        applied = F.greatest(F.least(pct - start, F.lit(width)), F.lit(0.0))
        match, start = match + salary * applied / 100 * (rate / 100), start + width
    parts = staff.withColumns({"_own": own, "_match": match})
    return parts.withColumns({
        "employee_contribution": F.round("_own", 2), "employer_match": F.round("_match", 2),
        "total_contribution": F.round(F.col("_own") + F.col("_match"), 2),
        "effective_match_rate": F.round(F.col("_match") / F.greatest(F.col("_own"), F.lit(1.0)) * 100, 1),
        "tip": F.when(pct < start, f"contribute at least {start:.0f}% to get the full match").otherwise("full match reached"),
    }).drop("_own", "_match")


def plan_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(p[0], p[1], *[float(x) for x in p[2:7]], p[7]) for p in HEALTH_PLANS],
        "plan_name string, coverage_tier string, employer_premium double, employee_premium double, deductible double, "
        "oop_max double, copay double, hsa_eligible boolean")


def health_cost(staff: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Premiums of the chosen plan and tier; an unknown plan is an error row, an unknown tier costs 0."""
    table = plan_table(staff.sparkSession) if catalogue is None else catalogue
    known = table.groupBy("plan_name").agg(F.bool_or("hsa_eligible").alias("hsa_eligible"))
    # a catalogue is small enough to be broadcast by its measured size; no hint is needed
    j = staff.join(table.drop("hsa_eligible"), ["plan_name", "coverage_tier"], "left").join(known, "plan_name", "left")
    found = F.col("hsa_eligible").isNotNull()
    zero = F.lit(0.0)
    return j.select(
        *staff.columns, F.when(~found, F.concat(F.lit("unknown plan "), F.col("plan_name"))).alias("error"),
        F.when(found, F.coalesce("employee_premium", zero)).alias("employee_monthly_cost"),
        F.when(found, F.coalesce("employer_premium", zero)).alias("employer_monthly_cost"),
        F.when(found, F.round(F.coalesce("employee_premium", zero) * 12, 2)).alias("annual_employee_cost"),
        "deductible", "oop_max", "copay", "hsa_eligible")


def benefits_summary(staff: DataFrame, as_of: str, further: dict[str, str] | None = None) -> DataFrame:
    """Leave, retirement and health of every employee in one nested row; ``further`` benefits (name -> text) hold for all."""
    rows = health_cost(retirement_match(pto_balance(staff, as_of)))
    pto = F.struct("accrued_days", "pto_used", "remaining_days", "days_until_reset", "forfeited_days")
    own = F.struct("employee_contribution", "employer_match", "total_contribution", "effective_match_rate", "tip")
    health = F.struct("plan_name", "coverage_tier", "error", "employee_monthly_cost", "annual_employee_cost", "deductible")
    misc = F.create_map(*[F.lit(x) for pair in (further or {}).items() for x in pair]).cast("map<string,string>")
    return rows.select("employee_id", pto.alias("pto"), own.alias("retirement"), health.alias("health"), misc.alias("misc"))

