"""Registered queries over the driver tables, with their SQL twins."""

from __future__ import annotations

from casewright.plans.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
