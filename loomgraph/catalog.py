"""All registered queries of the library, with their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

MODULES = ("code", "impact", "repositories", "content", "status", "reducers", "state", "surfaces", "extraction", "semantics", "lineage", "workflows", "structure", "infrastructure", "stores", "apis", "embedded", "delivery")


def _modules():
    return [import_module(f"loomgraph.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
