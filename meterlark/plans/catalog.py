"""All queries of the analytics part, and the SQL of each."""

from __future__ import annotations

from . import stream_queries, table_queries, write_queries  # noqa: F401  importing registers their queries
from .usage_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
