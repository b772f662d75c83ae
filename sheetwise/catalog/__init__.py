"""Registered queries, each next to the SQL that gives the same result."""

from __future__ import annotations

from sheetwise.catalog import charts, cleaning, diagnosis, documents, files, statistics, views
from sheetwise.catalog.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "charts", "cleaning", "diagnosis", "documents", "files", "statistics",
    "views",
]
