"""End-to-end jobs and the registered queries."""

from __future__ import annotations

import importlib

_MODULES = (
    "inventory_queries",
    "detect_queries",
    "fact_queries",
    "stack_queries",
    "audit_queries",
    "harvest_queries",
    "service_queries",
    "document_queries",
    "streaming_queries",
)


def load_queries():
    """The registry with every query module imported."""
    for name in _MODULES:
        importlib.import_module(f"corpuslens.plans.{name}")
    return importlib.import_module("corpuslens.plans.registry")
