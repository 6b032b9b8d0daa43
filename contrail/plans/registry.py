"""All queries by name, and their SQL oracles."""

from __future__ import annotations

from contrail.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
