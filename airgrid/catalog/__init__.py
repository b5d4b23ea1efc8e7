"""Query catalog: every registered operator as a Spark query plus its oracle SQL."""

from airgrid.catalog import q_explore, q_forecast, q_jobs, q_models, q_panel, q_sources  # noqa: F401  (registers queries)
from airgrid.catalog.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
