"""All survey queries with their SQL."""

from __future__ import annotations

from . import code_queries, report_queries, storage_queries  # noqa: F401  they register themselves
from .queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
