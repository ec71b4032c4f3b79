"""Application tracking: status and note events folded into one row per posting.

The fold is a plain aggregation over the events, so it combines before the shuffle and needs no
ordering of a posting's events in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postgrain.functions.text import trim


def fold_events(events: DataFrame) -> DataFrame:
    """Applications from (job_id, kind, value, at, seq); kind is "status" or "note".

    The last status wins and the first "applied" time is kept for good. A note never moves a
    tracked posting; on an untracked one it counts as shortlisting it. Blank notes are no notes.
    """
    order = F.struct("at", "seq")
    is_status, is_note = F.col("kind") == "status", F.col("kind") == "note"
    note = F.when(trim("value") != "", F.col("value"))
    folded = events.groupBy("job_id").agg(
        F.max_by(F.when(is_status, F.struct("value")), F.when(is_status, order)).alias("_status"),
        F.min_by(
            F.when(is_status & (F.col("value") == "applied"), F.col("at")),
            F.when(is_status & (F.col("value") == "applied"), order),
        ).alias("applied_at"),
        F.max_by(F.when(is_note, F.struct(note.alias("value"))), F.when(is_note, order)).alias("_note"),
        F.min_by("at", order).alias("created_at"),
        F.max_by("at", order).alias("updated_at"),
    )
    return folded.select(
        "job_id", F.coalesce("_status.value", F.lit("shortlisted")).alias("status"), "applied_at",
        F.col("_note.value").alias("notes"), "created_at", "updated_at",
    )


def merge_applications(current: DataFrame, events: DataFrame) -> DataFrame:
    """Fold new events onto stored applications."""
    new = fold_events(events)
    touched = events.groupBy("job_id").agg(
        F.bool_or(F.col("kind") == "status").alias("_moved"),
        F.bool_or(F.col("kind") == "note").alias("_noted"),
    )
    n = new.join(touched, "job_id").select("job_id", F.struct(
        "status", "applied_at", "notes", "created_at", "updated_at", "_moved", "_noted").alias("_n"))
    joined = current.join(n, "job_id", "full_outer")
    stored = F.col("status").isNotNull()
    return joined.select(
        "job_id",
        F.when(stored & ~F.coalesce("_n._moved", F.lit(False)), F.col("status"))
        .otherwise(F.coalesce("_n.status", "status")).alias("status"),
        F.coalesce("applied_at", "_n.applied_at").alias("applied_at"),
        F.when(F.coalesce("_n._noted", F.lit(False)), F.col("_n.notes")).otherwise(F.col("notes")).alias("notes"),
        F.coalesce("created_at", "_n.created_at").alias("created_at"),
        F.coalesce("_n.updated_at", "updated_at").alias("updated_at"),
    )


def tailoring_events(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """Status events for drafted postings: only untracked or shortlisted ones move to tailored."""
    current = applications.select("job_id", "status")
    return (
        jobs.join(current, "job_id", "left")
        .where(F.coalesce("status", F.lit("shortlisted")) == "shortlisted")
        .select("job_id", F.lit("status").alias("kind"), F.lit("tailored").alias("value"), "at", "seq")
    )


def list_applications(applications: DataFrame) -> DataFrame:
    """Latest change first."""
    return applications.orderBy(F.desc("updated_at"), F.desc("job_id"))
