"""All queries by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thermal_lake.plans import basic_queries, decision_queries, raster_queries, relational_queries

_MODULES = (raster_queries, relational_queries, decision_queries, basic_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
