"""Tenant routing table, canary split, usage metering and invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions.scalars import hash_share
from beaconry.functions.sequences import previous_row, lookup
from beaconry.settings import DEFAULTS

_CONFIG = ("stable_model", "canary_model", "canary_weight")


def _valid(changes: DataFrame) -> DataFrame:
    return changes.where((F.col("action") == "deregister") | F.col("canary_weight").between(0.0, 1.0))


def rejected_changes(changes: DataFrame) -> DataFrame:
    """Registrations whose canary weight lies outside [0, 1]."""
    return changes.where((F.col("action") == "register") & ~F.col("canary_weight").between(0.0, 1.0))


def current_registry(changes: DataFrame) -> DataFrame:
    """Routing table after every valid change: the latest one per tenant, unless it removes the tenant."""
    order = F.struct("changed_at", "change_id")
    newest = _valid(changes).groupBy("tenant_id").agg(
        F.max_by(F.struct("action", *_CONFIG), order).alias("c"))
    return newest.where("c.action = 'register'").select("tenant_id", *[f"c.{x}" for x in _CONFIG])


def deregistrations(changes: DataFrame) -> DataFrame:
    """Outcome of every removal: it fails where the tenant is not registered at that moment."""
    ordered = _valid(changes).withColumn("_order", F.struct("changed_at", "change_id"))
    block = F.date_diff(F.to_date("changed_at"), F.lit("1970-01-01").cast("date")) * 24 + F.hour("changed_at")
    seen = previous_row(ordered, ["tenant_id"], "_order", block, ["action"])
    return seen.where(F.col("action") == "deregister").select(
        "tenant_id", "change_id",
        F.when(F.col("prev_action") == "register", "removed").otherwise("not_found").alias("outcome"))


def without_tenants(registry: DataFrame, gone: DataFrame) -> DataFrame:
    return registry.join(gone.select("tenant_id").distinct(), "tenant_id", "left_anti")


def route(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Model that serves each request; the canary draw is fixed per request id, so replays agree.

    One tenant may send much of the traffic: its requests are split by the skewed-join rule, which must be switched on.
    """
    found = lookup(requests, registry, ["tenant_id"])
    canary = (F.coalesce(F.col("canary_model"), F.lit("")) != "") & (F.col("canary_weight") > 0) & (
        hash_share(F.col("request_id")) < F.col("canary_weight"))
    known = F.col("stable_model").isNotNull()
    return found.select(
        *requests.columns,
        F.when(known & F.coalesce(canary, F.lit(False)), F.col("canary_model")).otherwise(F.col("stable_model")).alias("model"),
        F.when(~known, "unknown_tenant").when(F.coalesce(canary, F.lit(False)), "canary").otherwise("stable").alias("route"))


def usage(events: DataFrame, *keys: str) -> DataFrame:
    """Calls per key; records with a count below one are refused."""
    return events.where(F.col("count") >= 1).groupBy(*keys).agg(F.sum("count").alias("calls"))


def usage_since_reset(events: DataFrame, resets: DataFrame) -> DataFrame:
    """Calls per tenant after its last reset (tenant_id, at; a null tenant resets all); 0 where nothing came after.

    Resets are one row per tenant once aggregated, and a single row for all.
    """
    own = resets.where(F.col("tenant_id").isNotNull()).groupBy("tenant_id").agg(F.max("at").alias("_own"))
    every = resets.where(F.col("tenant_id").isNull()).agg(F.max("at").alias("_all"))
    marked = events.join(own, "tenant_id", "left").join(F.broadcast(every))
    since = F.greatest("_own", "_all")  # ignores nulls
    counts = since.isNull() | (F.col("ts") > since)
    return marked.where(F.col("count") >= 1).groupBy("tenant_id").agg(
        F.coalesce(F.sum(F.when(counts, F.col("count"))), F.lit(0)).cast("bigint").alias("calls"))


def usage_of(registry: DataFrame, counted: DataFrame) -> DataFrame:
    """Calls of every registered tenant, 0 where there were none. Both sides have one row per tenant."""
    return registry.select("tenant_id").join(counted, "tenant_id", "left").select(
        "tenant_id", F.coalesce("calls", F.lit(0).cast("bigint")).alias("calls"))


def flat_price(calls: Column, price: float = DEFAULTS.price_per_prediction) -> Column:
    return F.round(calls * F.lit(price), 4)


def tiered_price(calls: Column, tiers=DEFAULTS.tier_prices) -> Column:
    """Marginal price: every tier prices only the calls that fall into it."""
    total, start = F.lit(0.0), 0.0
    for upper, price in tiers:
        top = calls.cast("double") if upper is None else F.least(calls.cast("double"), F.lit(upper))
        total = total + F.greatest(top - F.lit(start), F.lit(0.0)) * F.lit(price)
        start = upper if upper is not None else start
    return F.round(total, 4)


def invoices(counted: DataFrame, price: float = DEFAULTS.price_per_prediction) -> DataFrame:
    """One line per tenant and the total as tenant ``ALL``; counts are already one row per tenant."""
    lines = counted.select("tenant_id", "calls", flat_price(F.col("calls"), price).alias("amount"))
    return lines.rollup("tenant_id").agg(F.sum("calls").alias("calls"), F.round(F.sum("amount"), 4).alias("amount")).select(
        F.coalesce("tenant_id", F.lit("ALL")).alias("tenant_id"), "calls", "amount")
