"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from sieveloom.plans import analysis_queries, rule_queries, workflow_queries

QUERIES = {**rule_queries.QUERIES, **analysis_queries.QUERIES, **workflow_queries.QUERIES}
ORACLES = {**rule_queries.ORACLES, **analysis_queries.ORACLES, **workflow_queries.ORACLES}
