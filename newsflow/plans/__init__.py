"""Stages and registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("queries_text", "queries_tables", "queries_stats", "queries_vectors", "queries_sections")


def load_queries() -> tuple[dict, dict]:
    """All registered queries and the SQL of those that have one."""
    from newsflow.plans import registry

    for name in MODULES:
        import_module(f"newsflow.plans.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
