"""SQL text of the domain views for the checking engine.

``expand`` puts the views a statement names in front of it as common table expressions.
"""

from __future__ import annotations

import re

from beaconry.sources.bindings import SAMPLE_QUESTIONS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SAMPLE = ", ".join(f"(-1, {i}, {_quoted(q)})" for i, q in SAMPLE_QUESTIONS)

VIEWS: dict[str, str] = {
    "transactions": """
        SELECT l_orderkey, l_linenumber, l_extendedprice AS transaction_amount,
               CAST(l_suppkey * 20 AS DOUBLE) AS account_age, l_quantity AS num_transactions,
               l_discount AS merchant_risk, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
               CASE WHEN l_shipdate < TIMESTAMP '1997-01-01 00:00:00' THEN 'baseline' ELSE 'current' END AS side
        FROM lineitem""",
    "requests": """
        SELECT event_id AS request_id, ts, 'tenant_' || user_id AS tenant_id, event_type, value FROM events""",
    "tenant_registry": """
        SELECT 'tenant_' || c_custkey AS tenant_id, lower(c_mktsegment) || '_v1' AS stable_model,
               CASE WHEN c_nationkey % 2 = 0 THEN lower(c_mktsegment) || '_v2' END AS canary_model,
               CAST(c_nationkey % 5 AS DOUBLE) / 10 AS canary_weight
        FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "tenant_changes": """
        SELECT 'tenant_' || o_custkey AS tenant_id, o_orderkey AS change_id, o_orderdate AS changed_at,
               CASE WHEN o_orderstatus = 'P' THEN 'deregister' ELSE 'register' END AS action,
               'model_' || (o_orderkey % 7) AS stable_model,
               CASE WHEN o_orderkey % 3 = 0 THEN 'model_next' END AS canary_model,
               CAST(o_orderkey % 13 AS DOUBLE) / 10 AS canary_weight
        FROM orders""",
    "predictions": """
        SELECT d.doc_id, l.quality AS actual, CASE WHEN d.n_chars BETWEEN 200 AND 5000 THEN 1 ELSE 0 END AS prediction
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "metrics_history": """
        SELECT CAST(ts AS DATE) AS day,
               AVG(CASE WHEN event_type <> 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy,
               COUNT(*) AS total_predictions
        FROM events GROUP BY CAST(ts AS DATE)""",
    "vendor_spend": """
        SELECT l.l_suppkey AS vendor_id, s.s_name AS vendor_name, p.p_type AS category,
               SUM(l.l_extendedprice) AS total_spend, SUM(l.l_quantity) AS total_volume,
               SUM(l.l_extendedprice) / SUM(l.l_quantity) AS average_price
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
        GROUP BY l.l_suppkey, s.s_name, p.p_type""",
    "market_benchmarks": """
        SELECT category, AVG(average_price) AS market_price, AVG(total_volume) * 1.2 AS high_volume_threshold
        FROM vendor_spend WHERE category <> 'PROMO' GROUP BY category""",
    "contracts": """
        SELECT s_suppkey AS vendor_id, DATE '2024-01-01' + CAST((s_suppkey * 37) % 200 - 30 AS INT) AS expiry_date,
               CAST((s_suppkey % 3) * 30 AS INT) AS payment_terms_days
        FROM supplier WHERE s_suppkey % 10 <> 7""",
    "invoices": """
        SELECT l_suppkey AS vendor_id, l_orderkey AS order_key, SUM(l_extendedprice) AS amount
        FROM lineitem GROUP BY l_suppkey, l_orderkey""",
    "monthly_finance": """
        SELECT CAST(year(o.o_orderdate) * 12 + month(o.o_orderdate) - 1 AS INT) AS period,
               SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue,
               SUM(l.l_extendedprice * (0.6 + l.l_discount)) AS expenses,
               SUM(l.l_extendedprice * l.l_tax * 3) AS payroll
        FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1""",
    "employees": """
        SELECT c_custkey AS employee_id, c_name AS employee_name,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Senior Software Engineer' WHEN 'BUILDING' THEN 'Team Lead'
                    WHEN 'FURNITURE' THEN 'Account Executive' WHEN 'MACHINERY' THEN 'Finance Analyst'
                    ELSE 'Designer' END AS role,
               CASE c_custkey % 5 WHEN 0 THEN 'manager' WHEN 1 THEN 'director' ELSE 'individual_contributor' END AS level,
               DATE '2023-06-01' + CAST(c_custkey % 400 AS INT) AS start_date,
               CAST(50000 + 1000 * (c_custkey % 150) AS DOUBLE) AS salary,
               CAST(c_custkey % 13 AS DOUBLE) AS contribution_pct, CAST(c_custkey % 9 AS DOUBLE) AS pto_used,
               CASE c_custkey % 6 WHEN 0 THEN 'part_time_80' WHEN 1 THEN 'part_time_60' WHEN 2 THEN 'part_time_50'
                    WHEN 3 THEN 'contractor' ELSE 'full_time' END AS employment_type,
               CASE c_custkey % 4 WHEN 0 THEN 'PPO' WHEN 1 THEN 'HMO' WHEN 2 THEN 'HDHP' ELSE 'EPO' END AS plan_name,
               CASE c_custkey % 3 WHEN 0 THEN 'employee_only' WHEN 1 THEN 'family' ELSE 'unlisted_tier' END
                    AS coverage_tier
        FROM customer""",
    "crm_deals": """
        SELECT o_custkey AS account_id, o_totalprice AS amount, o_orderstatus AS deal_stage, o_orderdate AS created_at
        FROM orders""",
    "billing_charges": """
        SELECT user_id AS account_id, value AS amount, ts AS created_at FROM events WHERE event_type = 'purchase'""",
    "account_analytics": """
        SELECT c_custkey AS account_id, c_acctbal AS total_revenue,
               CAST(c_custkey % 101 AS DOUBLE) / 100 AS churn_risk_score
        FROM customer""",
    "questions": f"""
        SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'
        UNION ALL SELECT CAST(c AS BIGINT), CAST(i AS BIGINT), q FROM (VALUES {_SAMPLE}) v(c, i, q)""",
    "daily_kpi": """
        SELECT CAST(ts AS DATE) AS day, SUM(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS revenue,
               SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS orders,
               SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS visits
        FROM events GROUP BY CAST(ts AS DATE)""",
}


#: Views that a recursive one reads at each step.
ONCE: set[str] = set()


def add_view(name: str, sql: str, once: bool = False) -> None:
    """Declare a further view; families add their own intermediate results."""
    VIEWS[name] = sql
    if once:
        ONCE.add(name)


def _needs(sql: str, done: list[str], open_: tuple[str, ...] = ()) -> list[str]:
    for name in VIEWS:
        if name in done or name in open_:
            continue
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b(?!\s*(?:AS|[=.,(]))", sql, re.IGNORECASE):
            _needs(VIEWS[name], done, (*open_, name))
            done.append(name)
    return done


def expand(sql: str) -> str:
    names = _needs(sql, [])
    if not names:
        return sql
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({VIEWS[n]})" for n in names)
    own = re.match(r"\s*WITH\b(?:\s+RECURSIVE\b)?", sql, re.IGNORECASE)
    rest = "," + sql[own.end():] if own else sql
    return f"WITH RECURSIVE {head}\n{rest}"
