"""Registered queries of the transcript operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import history, limits, memory, stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = history.QUERIES | memory.QUERIES | limits.QUERIES | stream.QUERIES
ORACLE_SQL: dict[str, str] = history.ORACLE_SQL | memory.ORACLE_SQL | limits.ORACLE_SQL | stream.ORACLE_SQL
