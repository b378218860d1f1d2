"""All queries of the library by name, and their DuckDB counterparts."""

from __future__ import annotations

from sievewright.plans import dedup_plans, io_plans, model_plans, quality_plans, stat_plans, thread_plans

QUERIES: dict = {}
ORACLES: dict = {}
for _plans in (quality_plans, dedup_plans, thread_plans, stat_plans, model_plans, io_plans):
    QUERIES |= _plans.QUERIES
    ORACLES |= _plans.ORACLES
