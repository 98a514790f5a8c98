"""Named queries, one module per family."""

from __future__ import annotations

import importlib

FAMILIES = (
    "profiling", "reports", "monitoring", "tenancy", "sourcing", "finance", "revenue", "kpis",
    "people", "retrieval", "assistant", "scans", "contracts", "streams", "models",
)


def load_all():
    """Import every family once and return the filled registry."""
    for family in FAMILIES:
        importlib.import_module(f"beaconry.plans.{family}")
    from beaconry.plans.registry import REGISTRY

    return REGISTRY
