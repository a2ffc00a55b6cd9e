"""The query catalogue: each module of this package has ``QUERIES`` and ``SQL``."""

from __future__ import annotations

import importlib
import pkgutil


def catalogue() -> tuple[dict, dict]:
    """All queries and all SQL of this package's modules."""
    queries: dict = {}
    sql: dict = {}
    for info in pkgutil.iter_modules(__path__):
        module = importlib.import_module(f"{__name__}.{info.name}")
        queries |= getattr(module, "QUERIES", {})
        sql |= getattr(module, "SQL", {})
    return queries, sql
