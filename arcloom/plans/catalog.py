"""All registered queries of the library proper, and the SQL that says the same."""

from __future__ import annotations

from arcloom.plans import edge_plans, propagate_plans, ranking_plans, scatter_plans, structure_plans, temporal_plans  # noqa: F401
from arcloom.plans.registry import ORACLES, QUERIES  # noqa: F401
