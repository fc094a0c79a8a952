"""All queries of the engine with their SQL twins."""

from __future__ import annotations

from millrace.plans import aggregates, graphs, more, relational, scalars, sources, streams, windows  # noqa: F401
from millrace.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
