"""Supplier spend queries over the vendor, market, contract and invoice bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions.ordered import positions
from beaconry.operators import sourcing as P
from beaconry.plans.oracle_views import add_view
from beaconry.plans.registry import query
from beaconry.session import stored
from beaconry.sources import bindings as B

AS_OF = "2024-01-01"

add_view("priced", """
    SELECT v.*, m.market_price, (v.average_price - m.market_price) / m.market_price * 100 AS pct,
           coalesce(v.total_volume > m.high_volume_threshold, FALSE) AS vol
    FROM vendor_spend v LEFT JOIN market_benchmarks m ON v.category = m.category""")
add_view("renewals", f"""
    SELECT *, expiry_date - DATE '{AS_OF}' AS days_left, (expiry_date - DATE '{AS_OF}') BETWEEN 1 AND 90 AS near,
           CASE WHEN expiry_date - DATE '{AS_OF}' <= 30 THEN 'HIGH' WHEN expiry_date - DATE '{AS_OF}' <= 90 THEN 'MEDIUM'
                ELSE 'LOW' END AS pri FROM contracts""")
add_view("terms", """
    SELECT s.s_suppkey AS vendor_id, coalesce(nullif(c.payment_terms_days, 0), 30) AS cur,
           45 - coalesce(nullif(c.payment_terms_days, 0), 30) AS ext, coalesce(i.avg_amount, 0) AS avg_amount
    FROM supplier s LEFT JOIN contracts c ON c.vendor_id = s.s_suppkey
    LEFT JOIN (SELECT vendor_id, AVG(amount) AS avg_amount FROM invoices GROUP BY 1) i ON i.vendor_id = s.s_suppkey""")
add_view("opps", """
    SELECT p.*, CASE WHEN pct IS NOT NULL THEN least(100, pct + CASE WHEN vol THEN 15 ELSE 0 END) END AS score, coalesce(pct > 5, FALSE) AS above,
           coalesce(r.near, FALSE) AS near, r.days_left, r.pri, t.cur, t.ext,
           CASE WHEN pct > 5 THEN total_spend * pct / 100 ELSE 0 END + CASE WHEN vol THEN total_spend * 0.10 ELSE 0 END
           + CASE WHEN r.near THEN total_spend * 0.08 ELSE 0 END AS savings
    FROM priced p LEFT JOIN renewals r ON p.vendor_id = r.vendor_id LEFT JOIN terms t ON p.vendor_id = t.vendor_id
    WHERE CASE WHEN pct IS NOT NULL THEN least(100, pct + CASE WHEN vol THEN 15 ELSE 0 END) END > 20 OR r.near""")
add_view("opp_items", """
    SELECT vendor_id, category, 1 AS o, 'PRICE_REDUCTION' AS type, printf('price is %.1f%% over the market average', pct) AS d,
           CASE WHEN pct > 15 THEN 'HIGH' ELSE 'MEDIUM' END AS priority, total_spend * pct / 100 AS sv FROM opps WHERE above
    UNION ALL SELECT vendor_id, category, 2, 'VOLUME_DISCOUNT', 'volume reaches the discount tier', 'MEDIUM', total_spend * 0.10
    FROM opps WHERE vol
    UNION ALL SELECT vendor_id, category, 3, 'CONTRACT_RENEWAL', 'contract ends in ' || days_left || ' days', pri, total_spend * 0.08
    FROM opps WHERE near
    UNION ALL SELECT vendor_id, category, 4, 'PAYMENT_TERMS', 'extend terms from ' || cur || ' to 45 days', 'LOW', NULL
    FROM opps WHERE ext > 0""")
add_view("opp_advice", """
    SELECT o.*, coalesce((SELECT string_agg(d, '; ' ORDER BY o) FROM opp_items i WHERE i.vendor_id = o.vendor_id
                            AND i.category = o.category AND i.priority IN ('HIGH', 'CRITICAL')),
                         (SELECT arg_min(d, o) FROM opp_items i WHERE i.vendor_id = o.vendor_id AND i.category = o.category),
                         'look at the vendor''s price and contract terms') AS recommendation,
           CASE WHEN market_price > 0 THEN round(pct, 2) ELSE 0 END AS price_variance,
           CASE WHEN savings > 100000 THEN 'critical' WHEN savings > 50000 THEN 'high' WHEN savings > 10000 THEN 'medium'
                ELSE 'low' END AS lvl
    FROM opps o""")


def spend_table(t):
    """Spend per vendor and category, written once: pricing, benchmarks and terms all read it."""
    return stored(B.vendor_spend(t), "spend")


def _opps(t):
    spend = spend_table(t)
    return P.negotiation_opportunities(spend, B.market_benchmarks(spend), B.contracts(t), B.invoices(t), AS_OF)


@query("vendor_vs_market", """
    SELECT vendor_id, category, round(pct, 6) AS price_diff_pct, coalesce(pct > 5, FALSE) AS above_market,
           round(CASE WHEN pct > 0 THEN total_spend * pct / 100 ELSE 0 END, 2) AS price_savings, vol AS volume_eligible,
           round(CASE WHEN pct IS NOT NULL THEN least(100, pct + CASE WHEN vol THEN 15 ELSE 0 END) END, 6) AS negotiation_score FROM priced""")
def _vendor_vs_market(t):
    spend = spend_table(t)
    return P.price_against_market(spend, B.market_benchmarks(spend)).select(
        "vendor_id", "category", F.round("price_diff_pct", 6).alias("price_diff_pct"), "above_market",
        F.round("price_savings", 2).alias("price_savings"), "volume_eligible",
        F.round("negotiation_score", 6).alias("negotiation_score"))


@query("contract_renewal", """
    SELECT vendor_id, expiry_date, CAST(days_left AS INT) AS days_to_expiry, near AS near_renewal, pri AS renewal_priority FROM renewals""")
def _renewal(t):
    return P.contract_renewal(B.contracts(t), AS_OF).drop("payment_terms_days")


@query("payment_terms", """
    SELECT vendor_id, cur AS current_terms, ext AS term_extension, round(avg_amount * ext / 365, 4) AS cash_impact FROM terms""")
def _terms(t):
    ids = t.supplier.select(F.col("s_suppkey").alias("vendor_id"))
    return P.payment_terms(ids, B.contracts(t), B.invoices(t)).withColumn("cash_impact", F.round("cash_impact", 4))


@query("negotiation_opps", """
    SELECT vendor_id, category, round(score, 6) AS negotiation_score, round(savings, 2) AS savings_potential,
           (SELECT string_agg(type || ':' || priority, ',' ORDER BY o) FROM opp_items i
            WHERE i.vendor_id = opps.vendor_id AND i.category = opps.category) AS items FROM opps""")
def _negotiation(t):
    return _opps(t).select(
        "vendor_id", "category", F.round("negotiation_score", 6).alias("negotiation_score"),
        F.round("savings_potential", 2).alias("savings_potential"),
        F.nullif(F.array_join(F.transform("opportunities", lambda o: F.concat_ws(":", o["type"], o["priority"])), ","), F.lit(""))
        .alias("items"))


@query("opp_recommend", """
    SELECT vendor_id, category, recommendation, price_variance::DOUBLE AS price_variance FROM opp_advice""")
def _recommend(t):
    return P.recommend(_opps(t)).select("vendor_id", "category", "recommendation", "price_variance")


@query("opp_top3", """
    SELECT vendor_id, category, round(savings, 2) AS savings_potential FROM opps ORDER BY savings DESC, vendor_id, category LIMIT 3""")
def _top3(t):
    return _opps(t).orderBy(F.desc("savings_potential"), "vendor_id", "category").limit(3).select(
        "vendor_id", "category", F.round("savings_potential", 2).alias("savings_potential"))


@query("opp_portfolio", """
    SELECT COUNT(*) AS vendor_rows, round(SUM(savings), 2) AS total_savings, SUM(near::INT)::BIGINT AS renewals,
           (SELECT string_agg(DISTINCT category, ',' ORDER BY category) FROM opps WHERE above) AS categories,
           CASE WHEN COUNT(*) = 0 THEN 'NO_OPPORTUNITIES' WHEN SUM(savings) > 100000 THEN 'HIGH_SAVINGS_POTENTIAL' ELSE '' END AS risks
    FROM opps""")
def _portfolio(t):
    return P.portfolio(_opps(t))


@query("opp_route", "SELECT lvl AS priority, COUNT(*) AS n, round(SUM(savings), 2) AS savings FROM opp_advice GROUP BY 1")
def _route(t):
    return _opps(t).groupBy(P.priority_of(F.col("savings_potential")).alias("priority")).agg(
        F.count("*").alias("n"), F.round(F.sum("savings_potential"), 2).alias("savings"))


@query("opp_summary", """
    SELECT COUNT(*) AS total_opportunities, round(SUM(savings), 2) AS total_savings,
           SUM((lvl = 'critical')::INT)::BIGINT AS critical_count, SUM((lvl = 'high')::INT)::BIGINT AS high_count,
           SUM((lvl = 'medium')::INT)::BIGINT AS medium_count, SUM((lvl = 'low')::INT)::BIGINT AS low_count FROM opp_advice""")
def _summary(t):
    return P.summary(_opps(t))


@query("sink_alerts", """
    SELECT vendor_id, category, upper(lvl) AS priority, lvl AS alert_type,
           '[' || lvl || '] talk to ' || vendor_name AS subject,
           printf('%s: savings %.2f, price %.2f against market %.2f (%.2f%%). %s', vendor_name, savings, average_price,
                  coalesce(market_price, 0), price_variance::DOUBLE, recommendation) AS message FROM opp_advice""")
def _alerts(t):
    return P.alerts(P.recommend(_opps(t)))


@query("split_out", """
    SELECT vendor_id, category, type, priority, round(sv, 2) AS savings, d AS description FROM opp_items""")
def _split(t):
    rows = _opps(t).select("vendor_id", "category", F.inline("opportunities"))
    return rows.withColumn("savings", F.round("savings", 2))


@query("aggregate_all", """
    SELECT vendor_id, string_agg(category, ',' ORDER BY category) AS categories, COUNT(*) AS n FROM opps GROUP BY 1""")
def _aggregate(t):
    # at most one entry per category name and vendor
    return _opps(t).groupBy("vendor_id").agg(
        F.array_join(F.sort_array(F.collect_list("category")), ",").alias("categories"), F.count("*").alias("n"))


@query("merge_position", """
    WITH a AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS position FROM supplier),
         b AS (SELECT vendor_id, payment_terms_days, row_number() OVER (ORDER BY vendor_id) - 1 AS position FROM contracts),
         c AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part)
    SELECT position, s_name AS vendor_name, vendor_id AS contract_vendor, payment_terms_days, p_partkey AS part_key
    FROM a FULL JOIN b USING (position) FULL JOIN c USING (position)""")
def _merge_position(t):
    a = positions(t.supplier.select("s_suppkey", F.col("s_name").alias("vendor_name")), "s_suppkey")
    b = positions(B.contracts(t).select(F.col("vendor_id").alias("contract_vendor"), "payment_terms_days"), "contract_vendor")
    c = positions(t.part.select(F.col("p_partkey").alias("part_key")), "part_key")
    return a.drop("s_suppkey").join(b, "position", "full_outer").join(c, "position", "full_outer")


@query("price_change", """
    WITH o AS (SELECT l_suppkey AS vendor_id, l_partkey AS product, l_shipdate AS seen, SUM(l_extendedprice) / SUM(l_quantity) AS price,
                      SUM(l_quantity) AS volume FROM lineitem GROUP BY 1, 2, 3),
         p AS (SELECT *, lag(price) OVER (PARTITION BY vendor_id, product ORDER BY seen) AS before FROM o),
         c AS (SELECT *, round(price / before * 100 - 100, 1) AS pct FROM p WHERE before IS NOT NULL)
    SELECT vendor_id, product, seen AS "at", price, before AS previous_price,
           pct AS price_change_percent, volume AS order_volume,
           CASE WHEN pct > 20 THEN 'HIGH' WHEN pct > 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM c""")
def _price_change(t):
    bought = t.lineitem.groupBy(
        F.col("l_suppkey").alias("vendor_id"), F.col("l_partkey").alias("product"), F.col("l_shipdate").alias("at")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), F.sum("l_quantity").alias("volume"))
    return P.price_changes(bought)
