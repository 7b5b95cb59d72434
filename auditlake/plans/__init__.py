"""Registered queries: each pairs a Spark job with the SQL that must give the same rows."""

from __future__ import annotations

from auditlake.plans import brand, graph, history, live, pages, site, sources_sinks, text, urls  # noqa: F401
from auditlake.plans.registry import QUERIES, oracle

ORACLE = oracle()

__all__ = ["ORACLE", "QUERIES"]
