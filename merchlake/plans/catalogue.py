"""All registered queries over the driver's tables."""

from __future__ import annotations

from merchlake.plans import queries_listing, queries_mechanisms, queries_pages, queries_records, queries_relational, queries_scalar  # noqa: F401  they register themselves
from merchlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
