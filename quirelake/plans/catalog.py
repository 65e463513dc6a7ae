"""All registered queries of the core."""

from __future__ import annotations

from quirelake.plans import annotations, documents, inputs, layout, matching, releases, timers, viewer, visits  # noqa: F401
from quirelake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
