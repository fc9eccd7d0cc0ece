"""Registered queries, each next to the SQL that gives the same rows."""

from __future__ import annotations

from sheetlens.plans.queries import asking, charting, cleaning, mining, profiling, storing
from sheetlens.plans.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "asking", "charting", "cleaning", "mining", "profiling", "storing"]
