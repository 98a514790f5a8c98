"""Vendor pricing against market, contract and invoice data; opportunities and their routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds, rates and priorities of the negotiation rules.
ABOVE_MARKET_PCT, HIGH_PRICE_PCT, MIN_SCORE, VOLUME_POINTS, MAX_SCORE = 5, 15, 20, 15, 100
VOLUME_RATE, RENEWAL_RATE = 0.10, 0.08
RENEWAL_HIGH_DAYS, RENEWAL_NEAR_DAYS = 30, 90
STANDARD_TERMS, DEFAULT_TERMS = 45, 30
ROUTES = ((100_000, "critical"), (50_000, "high"), (10_000, "medium"))
PORTFOLIO_RISK_SAVINGS = 100_000
PRICE_JUMP_PCT, PRICE_WATCH_PCT = 20.0, 10.0


def price_against_market(vendors: DataFrame, market: DataFrame) -> DataFrame:
    """Deviation from the market price of the category; vendors without a market stay unscored."""
    j = vendors.join(market, "category", "left")
    pct = F.try_divide(F.col("average_price") - F.col("market_price"), F.col("market_price")) * 100
    eligible = F.coalesce(F.col("total_volume") > F.col("high_volume_threshold"), F.lit(False))
    return j.withColumn("price_diff_pct", pct).select(
        *vendors.columns, "market_price", "price_diff_pct",
        F.coalesce(F.col("price_diff_pct") > ABOVE_MARKET_PCT, F.lit(False)).alias("above_market"),
        F.when(F.col("price_diff_pct") > 0, F.col("total_spend") * F.col("price_diff_pct") / 100).otherwise(0.0)
        .alias("price_savings"),
        eligible.alias("volume_eligible"),
        F.when(F.col("price_diff_pct").isNotNull(), F.least(
            F.lit(float(MAX_SCORE)), F.col("price_diff_pct") + F.when(eligible, VOLUME_POINTS).otherwise(0)))
        .alias("negotiation_score"))


def first_contract(contracts: DataFrame) -> DataFrame:
    """One contract per vendor: the first to expire."""
    return contracts.groupBy("vendor_id").agg(
        F.min(F.struct("expiry_date", "payment_terms_days")).alias("c")).select("vendor_id", "c.*")


def contract_renewal(contracts: DataFrame, as_of: str) -> DataFrame:
    """Days to expiry, whether the negotiation window is open, and its priority."""
    days = F.date_diff("expiry_date", F.lit(as_of).cast("date"))
    return first_contract(contracts).withColumn("days_to_expiry", days).select(
        "vendor_id", "expiry_date", "payment_terms_days", "days_to_expiry",
        ((F.col("days_to_expiry") > 0) & (F.col("days_to_expiry") <= RENEWAL_NEAR_DAYS)).alias("near_renewal"),
        F.when(F.col("days_to_expiry") <= RENEWAL_HIGH_DAYS, "HIGH")
        .when(F.col("days_to_expiry") <= RENEWAL_NEAR_DAYS, "MEDIUM").otherwise("LOW").alias("renewal_priority"))


def payment_terms(vendor_ids: DataFrame, contracts: DataFrame, invoices: DataFrame) -> DataFrame:
    """Possible extension of the payment terms and its cash effect; every side has one row per vendor."""
    mean = invoices.groupBy("vendor_id").agg(F.avg(F.coalesce("amount", F.lit(0.0))).alias("average_invoice"))
    j = vendor_ids.join(first_contract(contracts), "vendor_id", "left").join(mean, "vendor_id", "left")
    terms = F.coalesce(F.nullif(F.col("payment_terms_days"), F.lit(0)), F.lit(DEFAULT_TERMS))
    return j.select(
        "vendor_id", terms.alias("current_terms"), (F.lit(STANDARD_TERMS) - terms).alias("term_extension"),
        (F.coalesce("average_invoice", F.lit(0.0)) * (F.lit(STANDARD_TERMS) - terms) / 365).alias("cash_impact"))


def negotiation_opportunities(
    vendors: DataFrame, market: DataFrame, contracts: DataFrame, invoices: DataFrame, as_of: str
) -> DataFrame:
    """Vendors worth talking to, each with its list of opportunities and the summed savings."""
    priced = price_against_market(vendors, market)
    renewal = contract_renewal(contracts, as_of).select(
        "vendor_id", "days_to_expiry", "near_renewal", "renewal_priority")
    terms = payment_terms(vendors.select("vendor_id").distinct(), contracts, invoices)
    j = priced.join(renewal, "vendor_id", "left").join(terms, "vendor_id", "left")
    near = F.coalesce(F.col("near_renewal"), F.lit(False))
    kept = j.where((F.col("negotiation_score") > MIN_SCORE) | near)

    def opportunity(on: Column, kind: str, text: Column, savings: Column, priority: Column) -> Column:
        return F.when(on, F.struct(
            F.lit(kind).alias("type"), text.alias("description"), savings.cast("double").alias("savings"),
            priority.alias("priority")))

    spend = F.col("total_spend")
    items = F.array_compact(F.array(
        opportunity(F.col("above_market"), "PRICE_REDUCTION",
                    F.format_string("price is %.1f%% over the market average", F.coalesce("price_diff_pct", F.lit(0.0))),
                    F.col("price_savings"), F.when(F.col("price_diff_pct") > HIGH_PRICE_PCT, "HIGH").otherwise("MEDIUM")),
        opportunity(F.col("volume_eligible"), "VOLUME_DISCOUNT", F.lit("volume reaches the discount tier"),
                    spend * VOLUME_RATE, F.lit("MEDIUM")),
        opportunity(near, "CONTRACT_RENEWAL",
                    F.concat(F.lit("contract ends in "), F.col("days_to_expiry").cast("string"), F.lit(" days")),
                    spend * RENEWAL_RATE, F.col("renewal_priority")),
        opportunity(F.col("term_extension") > 0, "PAYMENT_TERMS",
                    F.concat(F.lit("extend terms from "), F.col("current_terms").cast("string"),
                             F.lit(f" to {STANDARD_TERMS} days")),
                    F.lit(None), F.lit("LOW")),
    ))
    return kept.withColumn("opportunities", items).select(
        "vendor_id", "vendor_name", "category", "total_spend", "average_price", "market_price", "negotiation_score",
        "opportunities",
        F.aggregate("opportunities", F.lit(0.0), lambda a, o: a + F.coalesce(o["savings"], F.lit(0.0)))
        .alias("savings_potential"))


def recommend(opps: DataFrame) -> DataFrame:
    """Recommendation text and price variance per vendor row."""
    urgent = F.filter("opportunities", lambda o: o["priority"].isin("HIGH", "CRITICAL"))
    text = (
        F.when(F.size(urgent) > 0, F.array_join(F.transform(urgent, lambda o: o["description"]), "; "))
        .when(F.size("opportunities") > 0, F.col("opportunities")[0]["description"])
        .otherwise("look at the vendor's price and contract terms"))
    variance = F.round(F.try_divide(F.col("average_price") - F.col("market_price"), F.col("market_price")) * 100, 2)
    return opps.select(
        "*", text.alias("recommendation"),
        F.when(F.col("market_price") > 0, variance).otherwise(0.0).alias("price_variance"))


def priority_of(savings: Column) -> Column:
    out = F.lit("low")
    for limit, name in reversed(ROUTES):
        out = F.when(savings > limit, name).otherwise(out)
    return out


def alerts(recommended: DataFrame) -> DataFrame:
    """Alert rows ready to be written; nothing is sent."""
    level = priority_of(F.col("savings_potential"))
    return recommended.select(
        "vendor_id", "category", F.upper(level).alias("priority"), level.alias("alert_type"),
        F.concat(F.lit("["), level, F.lit("] talk to "), F.col("vendor_name")).alias("subject"),
        F.format_string(
            "%s: savings %.2f, price %.2f against market %.2f (%.2f%%). %s", "vendor_name", "savings_potential",
            "average_price", F.coalesce("market_price", F.lit(0.0)), "price_variance", "recommendation").alias("message"))


def summary(opps: DataFrame) -> DataFrame:
    level = priority_of(F.col("savings_potential"))
    return opps.agg(
        F.count("*").alias("total_opportunities"), F.round(F.sum("savings_potential"), 2).alias("total_savings"),
        *[F.count_if(level == p).alias(f"{p}_count") for p in ("critical", "high", "medium", "low")])


def portfolio(opps: DataFrame) -> DataFrame:
    """Totals over all vendors and the risk rows they imply; one category entry per category name."""
    def has(kind: str) -> Column:
        return F.exists("opportunities", lambda o: o["type"] == kind)

    p = opps.agg(
        F.count("*").alias("vendor_rows"), F.coalesce(F.sum("savings_potential"), F.lit(0.0)).alias("s"),
        F.count_if(has("CONTRACT_RENEWAL")).alias("renewals"),
        F.array_join(F.sort_array(F.collect_set(F.when(has("PRICE_REDUCTION"), F.col("category")))), ",").alias("categories"))
    return p.select(
        "vendor_rows", F.round("s", 2).alias("total_savings"), "renewals", "categories",
        F.concat_ws(",", F.when(F.col("vendor_rows") == 0, "NO_OPPORTUNITIES"),
                    F.when(F.col("s") > PORTFOLIO_RISK_SAVINGS, "HIGH_SAVINGS_POTENTIAL")).alias("risks"))


def price_changes(purchases: DataFrame) -> DataFrame:
    """Price against the purchase before, per vendor and product (vendor_id, product, at, price, volume).

    Purchases come summed to one row per day, so the calendar bounds the rows of a vendor and product.
    """
    seen = purchases.withColumn(
        "prev_price", F.lag("price").over(Window.partitionBy("vendor_id", "product").orderBy("at")))
    pct = F.round(F.try_divide(F.col("price"), F.col("prev_price")) * 100 - 100, 1)
    return seen.where(F.col("prev_price").isNotNull()).withColumn("price_change_percent", pct).select(
        "vendor_id", "product", "at", "price", F.col("prev_price").alias("previous_price"), "price_change_percent",
        F.col("volume").alias("order_volume"),
        F.when(F.col("price_change_percent") > PRICE_JUMP_PCT, "HIGH")
        .when(F.col("price_change_percent") > PRICE_WATCH_PCT, "MEDIUM").otherwise("LOW").alias("risk_level"))
