"""Importing this module registers every query."""

from __future__ import annotations

from pulseline.plans import tables_sql  # noqa: F401
from pulseline.plans import (  # noqa: F401
    activity_queries,
    bunching_queries,
    network_queries,
    question_queries,
    scenario_queries,
    schedule_queries,
    service_queries,
)
from pulseline.plans.registry import ENTRIES

__all__ = ["ENTRIES"]
