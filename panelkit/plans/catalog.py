"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from . import documents, estimates, panels, tables  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
