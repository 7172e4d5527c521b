"""Derived inputs and registered queries."""

from tidemark.plans import log_queries, schema_queries, table_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
