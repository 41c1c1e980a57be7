"""Registered queries: each operator over the given tables, with a DuckDB twin where SQL can express it."""

from scorewright.queries import fields, planning, records, reports
from scorewright.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "fields", "planning", "records", "reports"]
