"""The periodic pass over all events: nudge the overdue, archive the stale."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countersign.functions.steps import days_over, is_active, reference_clock

OVERDUE_DAYS = 14
ARCHIVE_DAYS = 45


def _at(now: Column | dt.datetime | str) -> Column:
    if isinstance(now, Column):
        return now
    return F.lit(now).cast("timestamp")


def sweep(events: DataFrame, now: Column | dt.datetime | str, overdue_days: float = OVERDUE_DAYS, archive_days: float = ARCHIVE_DAYS) -> DataFrame:
    """C7/A8. The transitions due at `now`: `(event_id, kind, days)`; archiving beats nudging.

    One scan, no shuffle: the clock comes from the steps nested in each record.
    """
    clock = reference_clock("type", "steps", "activated_at")
    df = events.filter(is_active()).withColumn("_days", days_over(_at(now), clock))
    kind = F.when(F.col("_days") >= archive_days, F.lit("archived")).when(
        (F.col("_days") >= overdue_days) & F.col("nudged_overdue_at").isNull(), F.lit("overdue")
    )
    return df.withColumn("kind", kind).filter("kind is not null").select(
        F.col("id").alias("event_id"), F.col("type").alias("event_type"), "title", "initiator", "kind",
        F.floor("_days").alias("days"),
    )


def apply_sweep(events: DataFrame, now: Column | dt.datetime | str, overdue_days: float = OVERDUE_DAYS, archive_days: float = ARCHIVE_DAYS) -> DataFrame:
    """C7. Event records after the pass."""
    at = _at(now)
    days = days_over(at, reference_clock("type", "steps", "activated_at"))
    stale = F.coalesce(is_active() & (days >= archive_days), F.lit(False))
    late = F.coalesce(
        is_active() & (days >= overdue_days) & (days < archive_days) & F.col("nudged_overdue_at").isNull(), F.lit(False)
    )
    return events.withColumns(
        {
            "archived_at": F.when(stale, at).otherwise(F.col("archived_at")),
            "archive_reason": F.when(stale, F.lit("auto_stale")).otherwise(F.col("archive_reason")),
            "nudged_overdue_at": F.when(late, at).otherwise(F.col("nudged_overdue_at")),
        }
    )


def sweep_notices(due: DataFrame, now: Column | dt.datetime | str) -> DataFrame:
    """C7. One notice to the initiator per transition."""
    return due.select(
        "event_id", "event_type", "title", "kind", "days", F.col("initiator").alias("to"),
        F.lit("sweep").alias("cause"), _at(now).alias("at"),
    )
