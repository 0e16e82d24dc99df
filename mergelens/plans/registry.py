"""Every registered query with its SQL."""

from __future__ import annotations

from mergelens.plans.queries import ORACLES, QUERIES

flagship = QUERIES["review"]

__all__ = ["ORACLES", "QUERIES", "flagship"]
