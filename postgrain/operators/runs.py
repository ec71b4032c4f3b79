"""The run log: one row per pipeline run, with its per-source statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.rules.constants import STALE_RUN_HOURS
from postgrain.schemas import SOURCE_STATS

RUNS = (
    "id bigint, started_at timestamp, finished_at timestamp, status string, "
    f"stats array<{SOURCE_STATS}>, error string"
)
STALE_MESSAGE = "never finished; marked failed at next startup"


def start_run(spark: SparkSession, run_id: int, started_at: datetime) -> DataFrame:
    """A one-row table to append to the log."""
    return spark.createDataFrame([(run_id, started_at, None, "running", [], None)], RUNS)


def finish_run(
    runs: DataFrame, run_id: int, status: str, finished_at: datetime, stats: DataFrame | None = None,
    error: str | None = None,
) -> DataFrame:
    """The log with one run closed. ``stats`` has one row per source (a short list of feeds)."""
    mine = F.col("id") == run_id
    out = runs
    if stats is not None:
        packed = stats.agg(F.array_sort(F.collect_list(F.struct(
            "source", "fetched", "created", "updated", "expired", "errors"))).alias("s"))
        out = out.withColumn(
            "stats", F.when(mine, packed.scalar().cast(f"array<{SOURCE_STATS}>"))
            .otherwise(F.col("stats"))
        )
    return out.withColumns({
        "status": F.when(mine, status).otherwise(F.col("status")),
        "finished_at": F.when(mine, F.lit(finished_at)).otherwise(F.col("finished_at")),
        "error": F.when(mine, F.lit(error)).otherwise(F.col("error")),
    })


def fail_stale_runs(runs: DataFrame, now: Column, hours: int = STALE_RUN_HOURS) -> DataFrame:
    """Mark runs left open for too long as failed, keeping an error they already carry."""
    stale = (F.col("status") == "running") & (
        F.col("started_at") < now - F.make_dt_interval(hours=F.lit(hours))
    )
    return runs.withColumns({
        "finished_at": F.when(stale, now).otherwise(F.col("finished_at")),
        "error": F.when(stale, F.coalesce("error", F.lit(STALE_MESSAGE))).otherwise(F.col("error")),
        "status": F.when(stale, "failed").otherwise(F.col("status")),
    })


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(1)


def get_run(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.where(F.col("id") == run_id)
