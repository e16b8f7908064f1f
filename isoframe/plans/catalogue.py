"""The library's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isoframe.plans import analysis_queries, cube_queries, interval_queries, reference_queries, result_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**interval_queries.QUERIES, **cube_queries.QUERIES, **analysis_queries.QUERIES, **result_queries.QUERIES, **reference_queries.QUERIES}
ORACLES: dict[str, str] = {**interval_queries.ORACLES, **cube_queries.ORACLES, **analysis_queries.ORACLES, **result_queries.ORACLES, **reference_queries.ORACLES}
