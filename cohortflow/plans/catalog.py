"""Imports every query module so that the registry is complete."""

from cohortflow.plans import attribution_queries, graph_queries, guard_queries, intake_queries, io_queries, model_queries, study_queries  # noqa: F401
from cohortflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
