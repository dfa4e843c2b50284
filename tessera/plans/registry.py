"""The registered queries of the engine itself, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


for _module in ("cell_plans", "document_plans", "search_plans", "graph_plans", "branch_plans", "table_plans"):
    importlib.import_module(f"tessera.plans.{_module}")
