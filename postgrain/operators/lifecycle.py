"""First-seen / last-seen / expired lifecycle over incremental runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postgrain.rules.constants import MAX_MISSED_RUNS
from postgrain.schemas import POSTING_KEY

KEY = list(POSTING_KEY)


def first_seen_dedupe(items: DataFrame, *order: str) -> DataFrame:
    """One row per (source, source_native_id): the first in feed order."""
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy(*order))
    return items.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def covered_since(items: DataFrame, walks: DataFrame) -> DataFrame:
    """Oldest posting each feed walk vouches for; null when the walk saw the whole feed.

    ``walks`` holds (source, ended_on_feed).
    """
    oldest = items.groupBy("source").agg(F.min("posted_at").alias("_oldest"))
    return walks.join(oldest, "source", "left").select(
        "source", F.when(~F.col("ended_on_feed"), F.col("_oldest")).alias("covered_since")
    )


def upsert_postings(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """New snapshot: content of the last batch row per key, lifecycle carried over.

    ``batch`` has the posting columns plus seq and seen_at. A seen posting is active with no
    missed runs, also when it had expired; its first sighting is kept. The de-duplication, the
    first-sighting aggregate and the join all partition by the posting key, so the wide batch rows
    move once.
    """
    last = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("seq")))
    newest = batch.withColumn("_rank", last).where("_rank = 1").drop("_rank", "seq")
    first = batch.groupBy(*KEY).agg(F.min_by("seen_at", "seq").alias("_first"))
    incoming = newest.join(first, KEY)
    content = [c for c in incoming.columns if c not in (*KEY, "seen_at", "_first")]
    b = incoming.select(
        *KEY, F.struct("seen_at", "_first", *content).alias("_b")
    )
    joined = existing.join(b, KEY, "full_outer")
    seen = F.col("_b").isNotNull()
    updated = {
        c: F.when(seen, F.col(f"_b.{c}")).otherwise(F.col(c))
        for c in existing.columns if c in content
    }
    return joined.select(
        *KEY,
        *[updated[c].alias(c) if c in updated else F.col(c) for c in existing.columns
          if c not in (*KEY, "first_seen_at", "last_seen_at", "missed_runs", "status")],
        F.coalesce("first_seen_at", "_b._first").alias("first_seen_at"),
        F.coalesce("_b.seen_at", "last_seen_at").alias("last_seen_at"),
        F.when(seen, 0).otherwise(F.col("missed_runs")).alias("missed_runs"),
        F.when(seen, "active").otherwise(F.col("status")).alias("status"),
    )


def _swept(covered_since: Column) -> Column:
    in_window = F.col("posted_at").isNotNull() & (F.col("posted_at") >= covered_since)
    return (
        (F.col("status") == "active")
        & (F.col("last_seen_at") < F.col("_started"))
        & (covered_since.isNull() | in_window)
    )


def sweep_missing(
    postings: DataFrame, runs: DataFrame, max_missed: int = MAX_MISSED_RUNS
) -> DataFrame:
    """Count a missed run for unseen active postings; expire those at the limit.

    ``runs`` has one row per swept source: (source, started_at, covered_since). Sources without a
    row are left alone; with a covered_since, only postings dated inside the window count. Adds
    ``expired_now``.
    """
    plan = runs.select(
        "source", F.col("started_at").alias("_started"), F.col("covered_since").alias("_covered")
    )
    joined = postings.join(plan, "source", "left")
    missed = F.when(
        F.coalesce(_swept(F.col("_covered")), F.lit(False)), F.col("missed_runs") + 1
    ).otherwise(F.col("missed_runs"))
    counted = joined.withColumn("missed_runs", missed)
    expires = (
        F.col("_started").isNotNull() & (F.col("status") == "active")
        & (F.col("missed_runs") >= max_missed)
    )
    return counted.withColumn("expired_now", expires).withColumn(
        "status", F.when(F.col("expired_now"), "expired").otherwise(F.col("status"))
    ).select(*postings.columns, "expired_now")


def ranked_runs(sightings: DataFrame) -> DataFrame:
    """Runs of each source numbered 1.. in order, with their total.

    The window holds one row per run of a source, however many postings the run saw.
    """
    runs = sightings.select("source", "run").distinct()
    by_run = W.partitionBy("source").orderBy("run")
    return runs.withColumns({
        "run_no": F.row_number().over(by_run),
        "runs": F.count("*").over(W.partitionBy("source")),
    })


def lifecycle_history(sightings: DataFrame, max_missed: int = MAX_MISSED_RUNS) -> DataFrame:
    """State of each posting after a whole history of runs, in closed form.

    ``sightings``: (source, source_native_id, run, seen_at). Missed runs are those of the source
    after the last sighting, capped at the limit; a gap longer than the limit between sightings is
    an expiry followed by a revival.
    """
    runs = ranked_runs(sightings)
    daily = sightings.groupBy(*KEY, "run").agg(
        F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at")
    ).join(runs, ["source", "run"])
    before = F.lag("run_no").over(W.partitionBy(*KEY).orderBy("run_no"))
    gap = F.col("run_no") - before
    return (
        daily.withColumn("_revived", F.coalesce((gap > max_missed).cast("int"), F.lit(0)))
        .groupBy(*KEY).agg(
            F.min("first_at").alias("first_seen_at"), F.max("last_at").alias("last_seen_at"),
            F.least(F.lit(max_missed), F.max("runs") - F.max("run_no")).alias("missed_runs"),
            F.sum("_revived").alias("revivals"),
        )
        .withColumn(
            "status", F.when(F.col("missed_runs") >= max_missed, "expired").otherwise("active")
        )
    )


def run_stats(sightings: DataFrame, max_missed: int = MAX_MISSED_RUNS) -> DataFrame:
    """Fetched, created, updated and expired postings per (source, run)."""
    runs = ranked_runs(sightings)
    per_key = sightings.groupBy(*KEY, "run").agg(F.count("*").alias("n")).join(
        runs, ["source", "run"]
    )
    order = W.partitionBy(*KEY).orderBy("run_no")
    marked = per_key.withColumns({
        "_first": F.lag("run_no").over(order).isNull(),
        "_next": F.lead("run_no").over(order),
    })
    gone = (F.coalesce("_next", F.col("runs") + 1) - F.col("run_no")) > max_missed
    expiries = marked.where(gone).select(
        "source", (F.col("run_no") + max_missed).alias("run_no"), F.lit(1).alias("x")
    ).groupBy("source", "run_no").agg(F.sum("x").alias("expired"))
    counted = marked.groupBy("source", "run", "run_no").agg(
        F.sum("n").alias("fetched"), F.sum(F.col("_first").cast("bigint")).alias("created")
    )
    return counted.join(expiries, ["source", "run_no"], "left").select(
        "source", "run", "fetched", "created",
        (F.col("fetched") - F.col("created")).alias("updated"),
        F.coalesce("expired", F.lit(0)).cast("bigint").alias("expired"),
    )


def stored_descriptions(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """Stored non-empty descriptions of the wanted (source, source_native_id) rows."""
    return (
        postings.where("description <> ''").select(*KEY, "description")
        .join(wanted.select(*KEY), KEY, "left_semi")
    )


def active_postings(postings: DataFrame) -> DataFrame:
    return postings.where("status = 'active'")


def postings_by(postings: DataFrame, **values) -> DataFrame:
    """Point lookup by any columns, null-safe, in id order; predicates reach the scan."""
    for name, value in values.items():
        column = F.col(name)
        postings = postings.where(column.isNull() if value is None else column == value)
    return postings.orderBy("id")


def postings_by_key(
    postings: DataFrame, company_normalized: str, title_family: str | None, location_key: str
) -> DataFrame:
    """Postings of one fingerprint block, in id order."""
    return postings_by(
        postings, company_normalized=company_normalized, title_family=title_family,
        location_key=location_key,
    )


def active_by_source(postings: DataFrame) -> DataFrame:
    return active_postings(postings).groupBy("source").agg(
        F.count("*").alias("active"), F.max("last_seen_at").alias("last_seen_at")
    )
