"""All queries of the engine, by name, with their DuckDB SQL."""

from __future__ import annotations

from galeframe.plans import display, forecast, physics, relational, rules, scalar, search, services, sources

MODULES = (scalar, relational, search, physics, sources, display, services, forecast, rules)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
