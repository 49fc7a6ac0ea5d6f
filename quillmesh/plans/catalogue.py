"""All general queries and the SQL of those that SQL can express."""

from __future__ import annotations

from quillmesh.plans import engine, extras, measures, relational, search, texts
from quillmesh.plans.registry import Query

_MODULES = (texts, measures, search, relational, engine, extras)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _MODULES:
        clash = found.keys() & module.query.queries.keys()
        if clash:
            raise ValueError(f"queries named twice: {sorted(clash)}")
        found |= module.query.queries
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.query.sql.items()}
