"""The ranked list a user reads: one row per role, with its application status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.functions.labels import application_stage, next_action
from postgrain.rules.constants import DIMENSIONS, SHORTLIST_CAP, SHORTLIST_DEFAULT

EXPORT_COLUMNS = (
    "score", "company", "title", "source", "location", "remote", "stage", "next_action", "status",
    "applied_at", "status_updated_at", "title_family", "seniority", "salary", "also_posted_in",
    "posted_at", "scored_at", "url", "job_id",
)


def ranked_roles(
    postings: DataFrame, scores: DataFrame, rubric_version: str, profile_version: str | None = None
) -> DataFrame:
    """Best (job_id, rubric_score) of every (company, description) with the count of its copies.

    An aggregation rather than a window: copies are folded before the shuffle, so a role posted a
    million times is a handful of rows, and only ids and scores move.
    """
    wanted = scores.where(
        (F.col("rubric_version") == rubric_version) & F.col("hard_filter_pass")
        & F.col("rubric_score").isNotNull()
    )
    if profile_version is not None:
        wanted = wanted.where(F.col("profile_version") == profile_version)
    slim = postings.where("status = 'active'").select(
        F.col("id").alias("job_id"), "company_normalized",
        F.col("description_hash").alias("_hash"),
    )
    rows = wanted.select("job_id", "rubric_score", "profile_version").join(slim, "job_id")
    return rows.groupBy("company_normalized", "_hash").agg(
        (F.count("*") - 1).alias("also_posted_in"),
        F.min(F.struct((-F.col("rubric_score")).alias("n"), "job_id", "profile_version")).alias("_best"),
    ).select(
        F.col("_best.job_id").alias("job_id"), (-F.col("_best.n")).alias("rubric_score"),
        F.col("_best.profile_version").alias("profile_version"), "also_posted_in",
    )


def role_entries(
    roles: DataFrame, postings: DataFrame, scores: DataFrame, applications: DataFrame, rubric_version: str
) -> DataFrame:
    """Every row of ``roles`` with its posting, score and application columns."""
    detail = postings.withColumnRenamed("id", "job_id").join(roles, "job_id")
    score_columns = scores.where(F.col("rubric_version") == rubric_version).select(
        "job_id", "profile_version", "scored_at",
        *[c for c in ("dimensions", "uncertainty", "rationale", "retrieval_score")
          if c in scores.columns],
    )
    apps = applications.select(
        "job_id", F.col("status").alias("application_status"), "applied_at", "notes",
        F.col("updated_at").alias("status_updated_at"),
    )
    return detail.join(score_columns, ["job_id", "profile_version"]).join(apps, "job_id", "left")


def all_entries(
    postings: DataFrame, scores: DataFrame, applications: DataFrame, rubric_version: str,
    profile_version: str | None = None, include_dismissed: bool = False,
) -> DataFrame:
    """Every role with posting, score and application columns, in no order: what counts, filters,
    sources and exports read. ``shortlist`` is a page of it."""
    roles = ranked_roles(postings, scores, rubric_version, profile_version)
    joined = role_entries(roles, postings, scores, applications, rubric_version)
    return joined if include_dismissed else hide_dismissed(joined)


def shortlist(
    postings: DataFrame, scores: DataFrame, applications: DataFrame, rubric_version: str,
    profile_version: str | None = None, limit: int = SHORTLIST_DEFAULT,
    include_dismissed: bool = False,
) -> DataFrame:
    """One page of top roles with posting, score and application columns.

    The limit comes first and dismissed rows are hidden afterwards, so fewer rows may come back.
    Full rows are fetched only for the ids that made the list. A limit above the cap is refused.
    """
    if limit > SHORTLIST_CAP:
        raise ValueError(f"limit {limit}; a page has at most {SHORTLIST_CAP} roles, all_entries has them all")
    top = ranked_roles(postings, scores, rubric_version, profile_version).orderBy(
        F.desc("rubric_score"), "job_id"
    ).limit(limit)
    # at most SHORTLIST_CAP ids: safe to broadcast whatever the tables hold
    joined = role_entries(
        F.broadcast(top), postings,
        scores.join(F.broadcast(top.select("job_id", "profile_version")), ["job_id", "profile_version"], "left_semi"),
        applications.join(F.broadcast(top.select("job_id")), "job_id", "left_semi"), rubric_version)
    if not include_dismissed:
        joined = hide_dismissed(joined)
    return joined.orderBy(F.desc("rubric_score"), "job_id")


def hide_dismissed(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("application_status").eqNullSafe("dismissed"))


def with_progress(entries: DataFrame) -> DataFrame:
    return entries.withColumns({
        "stage": application_stage("application_status"),
        "next_action": next_action("application_status"),
    })


def stage_counts(entries: DataFrame) -> DataFrame:
    return with_progress(entries).groupBy("stage").agg(F.count("*").alias("entries"))


def filter_entries(
    entries: DataFrame, stage: str | None = None, source: str = "", text: str = ""
) -> DataFrame:
    """Stage and source by equality; text as a case-insensitive part of company or title."""
    out = with_progress(entries)
    if stage is not None:
        out = out.where(F.col("stage") == stage)
    if source:
        out = out.where(F.col("source") == source)
    needle = text.strip().lower()
    if needle:
        def has(column: str) -> Column:
            return F.contains(F.lower(F.col(column)), F.lit(needle))
        out = out.where(has("company") | has("title"))
    return out


def distinct_sources(entries: DataFrame) -> DataFrame:
    return entries.select("source").distinct().orderBy("source")


def export_rows(entries: DataFrame) -> DataFrame:
    """The fixed export columns, in order."""
    shaped = with_progress(entries).withColumns({
        "score": F.col("rubric_score"),
        "remote": F.when(F.col("remote"), "remote").otherwise("onsite"),
        "status": F.col("application_status"),
        "salary": F.col("salary_text"),
    })
    return shaped.select(*EXPORT_COLUMNS)


def dimension_rows(scores: DataFrame) -> DataFrame:
    """Six labelled rows per scored row, in display order; none where nothing is scored."""
    rows = F.array(*[
        F.struct(
            F.lit(place).alias("place"), F.lit(name).alias("dimension"), F.lit(label).alias("label"),
            F.col("dimensions")[name]["score"].alias("score"),
            F.col("dimensions")[name]["evidence"].alias("evidence"),
            F.col("dimensions")[name]["note"].alias("note"),
        )
        for place, (name, label) in enumerate(DIMENSIONS, start=1)
    ])
    return scores.where("dimensions IS NOT NULL").select("job_id", F.inline(rows))
