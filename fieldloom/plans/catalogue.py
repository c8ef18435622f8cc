"""Named queries over the test tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.plans import mapping_plans, model_plans, round_trip_plans, text_plans, vector_plans

_MODULES = (text_plans, mapping_plans, vector_plans, model_plans, round_trip_plans)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}

flagship = vector_plans.flagship
