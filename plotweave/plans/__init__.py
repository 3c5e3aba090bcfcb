"""Registered queries, grouped by theme."""

from plotweave.plans import clashes, files, matching, records, shapes, vocabulary  # noqa: F401
from plotweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
