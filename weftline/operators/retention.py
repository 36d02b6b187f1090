"""Idle sessions: which have had no activity for a number of days, and the rows without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS, DEFAULT_DAYS = 86_400_000, 30
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def retention_days(days: Column) -> Column:
    """A positive finite number, or the default."""
    days = days.cast("double")
    return F.when((days > 0) & (days < float("inf")), days).otherwise(float(DEFAULT_DAYS))


def stale_sessions(sessions: DataFrame, files: DataFrame, now_ms: int, days: float = DEFAULT_DAYS, current: str | None = None, name: str | None = UUID) -> DataFrame:
    """session_id, newest_ms of sessions (session_id) whose newest file (session_id, mtime_ms) is older than that, oldest
    first; one without files is as old as can be. Only names of the pattern count, and never the current session."""
    newest = files.groupBy("session_id").agg(F.max("mtime_ms").alias("newest_ms"))
    found = sessions.select("session_id").distinct().join(newest, "session_id", "left").withColumn("newest_ms", F.greatest(F.lit(0), F.coalesce("newest_ms", F.lit(0))))
    found = found.where(F.col("newest_ms") < now_ms - days * DAY_MS)
    if name:
        found = found.where(F.col("session_id").rlike(name))
    if current:
        found = found.where(F.col("session_id") != current)
    return found.orderBy("newest_ms", "session_id")


def retained(rows: DataFrame, stale: DataFrame) -> DataFrame:
    return rows.join(stale.select("session_id"), "session_id", "left_anti")
