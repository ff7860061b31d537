"""Registry of the core queries and their DuckDB forms: one module per system, each with QUERIES and SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("measurements", "contamination", "traffic", "evaluations", "preference", "judges", "agents", "sources", "reports")


def core_queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f".{m}", __name__).QUERIES.items()}


def core_sql() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f".{m}", __name__).SQL.items()}
