"""All queries over the driver's tables, by name."""

from __future__ import annotations

from . import shape_queries, table_queries, text_queries  # noqa: F401  (importing registers them)
from .base import QUERIES, SQL

flagship = table_queries.flagship


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
