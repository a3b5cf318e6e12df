"""Registered queries: each operator over the given tables, with SQL for the same result."""

from __future__ import annotations

from catalog import registry
from catalog import analysis, fits, io, relational, reshape, text_charts  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
