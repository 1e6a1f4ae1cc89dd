"""Analytic queries with row-level lineage, as plain PySpark DataFrame jobs."""

from rowtrace.operators.lineage import Lineage, Traced
from rowtrace.session import Limits, build_session, release_caches
from rowtrace.sources.tables import Tables

__all__ = ["Lineage", "Limits", "Tables", "Traced", "build_session", "release_caches"]
