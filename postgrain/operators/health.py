"""Pipeline health: one row per check, worst news first decided by fixed thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.operators.lifecycle import active_by_source
from postgrain.operators.shortlist import ranked_roles
from postgrain.rules import constants as C


def hours_since(at: Column, now: Column) -> Column:
    gap = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return gap / F.lit(3_600_000_000.0)


def _age_level(age: Column) -> Column:
    return F.when(age > C.RUN_FAIL_HOURS, "fail").when(age > C.RUN_WARN_HOURS, "warn").otherwise("ok")


def _row(df: DataFrame, place: int, level, label, detail) -> DataFrame:
    as_col = [x if isinstance(x, Column) else F.lit(x) for x in (level, label, detail)]
    return df.select(
        F.lit(place).alias("place"), as_col[0].alias("level"), as_col[1].alias("label"),
        as_col[2].alias("detail"),
    )


def _one(df: DataFrame, ident: Column) -> DataFrame:
    """The row with the largest id, or one row of nulls."""
    return df.agg(F.max_by(F.struct(*df.columns), ident).alias("r")).select("r.*")


def _run_age(runs: DataFrame, place: int, label: str, missing: str, now: Column) -> DataFrame:
    last = _one(runs.select("id", "finished_at"), F.col("id"))
    age = hours_since(F.col("finished_at"), now)
    absent = F.col("id").isNull()
    return _row(
        last.where(absent | F.col("finished_at").isNotNull()), place,
        F.when(absent, "fail").otherwise(_age_level(age)), label,
        F.when(absent, missing).otherwise(
            F.format_string("#%d completed %.1fh ago", F.col("id"), age)),
    )


def source_problems(scan: DataFrame, active: DataFrame, now: Column) -> DataFrame:
    """(id, source, problem) for the sources of a scan; problem is null where all is well."""
    stats = scan.select("id", F.inline("stats"))
    age = hours_since(F.col("last_seen_at"), now)
    return stats.join(active, "source", "left").select(
        "id", "source",
        F.when(F.col("errors") > 0, F.format_string("%s errored (%d)", "source", "errors"))
        .when(F.col("fetched") == 0, F.concat("source", F.lit(" fetched 0")))
        .when(F.col("active").isNull(), F.concat("source", F.lit(" has no active postings")))
        .when(age > C.SOURCE_STALE_HOURS, F.format_string("%s last seen %.0fh ago", F.col("source"), age))
        .alias("problem"),
    )


def health_report(
    runs: DataFrame, postings: DataFrame, scores: DataFrame, profile_version: str | None,
    now: Column, rubric_version: str = C.RUBRIC_VERSION,
) -> DataFrame:
    """(place, level, label, detail) per check. Lists inside a detail cover runs or feeds only."""
    spark = runs.sparkSession
    one = spark.range(1)
    completed = runs.where("status = 'completed'")
    scans = completed.where(F.size("stats") > 0)
    checks = [
        _row(one, 1, "fail", "profile", "no profile") if profile_version is None
        else _row(one, 1, "ok", "profile", f"version {profile_version}"),
        _run_age(completed.where("finished_at IS NOT NULL"), 2, "last run", "no completed run", now),
    ]

    stuck = hours_since(F.col("started_at"), now) > C.STALE_RUN_HOURS
    running = runs.where("status = 'running'").agg(
        F.count("*").alias("n"), F.count_if(stuck).alias("stale"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(stuck, F.col("id")))),
            lambda i: F.concat(F.lit("#"), i.cast("string"))), ", ").alias("ids"),
    ).where("n > 0")
    checks.append(_row(
        running, 3, F.when(F.col("stale") > 0, "warn").otherwise("ok"),
        F.when(F.col("stale") > 0, "aborted runs").otherwise("runs"),
        F.when(F.col("stale") > 0, F.format_string("%d stuck at 'running' (%s)", "stale", "ids"))
        .otherwise(F.format_string("%d in progress", "n")),
    ))
    checks.append(_run_age(scans, 4, "last scan", "no completed scan", now))

    last_scan = scans.join(
        scans.agg(F.max("id").alias("id")), "id", "left_semi").select("id", "stats")
    active = active_by_source(postings)
    problems = source_problems(last_scan, active, now).groupBy("id").agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.col("problem").isNotNull(), F.struct("source", "problem")))),
            lambda p: p["problem"]), "; ").alias("list"),
    )
    bad = F.col("list") != ""
    checks.append(_row(
        problems, 5, F.when(bad, "warn").otherwise("ok"),
        F.format_string("sources (scan #%d)", "id"),
        F.when(bad, F.col("list")).otherwise(F.format_string("%d fetched, all fresh", "n")),
    ))

    scanned = last_scan.select(F.inline("stats")).select("source")
    unscanned = active.join(scanned, "source", "left_anti").agg(
        F.array_join(F.array_sort(F.collect_list("source")), ", ").alias("list"))
    has_scan = F.coalesce(last_scan.agg(F.count("*")).scalar(), F.lit(0))
    checks.append(_row(
        unscanned.withColumn("_scans", has_scan).where("list <> '' AND _scans > 0"), 6, "ok",
        "unscanned sources",
        F.concat(F.lit("active rows from feeds the last scan did not fetch: "), "list"),
    ))

    alive = postings.where("status = 'active'").select(F.col("id").alias("job_id"))
    backlog = scores.where(
        (F.col("rubric_version") == rubric_version) & F.col("hard_filter_pass")
        & F.col("rubric_score").isNull()
    ).join(alive, "job_id", "left_semi").agg(F.count("*").alias("n"))
    over = F.col("n") > C.BACKLOG_WARN
    checks.append(_row(
        backlog, 7, F.when(over, "warn").otherwise("ok"), "unscored backlog",
        F.when(over, F.format_string(
            f"%d passing jobs unscored — more than one scan's budget ({C.BACKLOG_WARN})", "n"))
        .otherwise(F.format_string("%d passing jobs awaiting a rubric call", "n")),
    ))

    finished = _one(runs.where("status <> 'running'").select("id", "error"), F.col("id"))
    calls = F.regexp_count("error", F.lit("scoring failed"))
    brief = F.when(
        F.length("error") > 160, F.concat(F.substring("error", 1, 160), F.lit("…"))
    ).otherwise(F.col("error"))
    checks.append(_row(
        finished.where("error IS NOT NULL"), 8, "warn", F.format_string("run #%d errors", "id"),
        F.when(calls > 0, F.format_string("%d rubric calls failed", calls)).otherwise(brief),
    ))

    listed = ranked_roles(postings, scores, rubric_version, profile_version).agg(F.count("*").alias("n"))
    checks.append(_row(
        listed, 9, F.when(F.col("n") == 0, "warn").otherwise("ok"), "shortlist",
        F.format_string("%d scored entries at the current profile", "n"),
    ))
    return reduce(DataFrame.unionByName, checks)


def is_healthy(report: DataFrame) -> DataFrame:
    """One row: no check failed."""
    return report.agg((F.count_if(F.col("level") == "fail") == 0).alias("healthy"))
