"""All queries of the engine, by name, and the SQL of those that an oracle can run."""

from __future__ import annotations

from geoweave.plans import causal_queries, driver_queries, feature_group_queries, feature_queries, fusion_queries, report_queries, transition_queries
from geoweave.plans.registry import ORACLES, QUERIES

MODULES = (fusion_queries, transition_queries, feature_queries, feature_group_queries, driver_queries, causal_queries, report_queries)
__all__ = ["MODULES", "ORACLES", "QUERIES"]
