"""Budgeted, cached scoring with a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.functions.labels import clamp_dimensions, clamp_overall
from postgrain.rules import constants as C
from postgrain.schemas import SCORE_RESULT

PROVENANCE = ("prompt_version", "profile_version", "model_id")


def parse_budget(text: str | None) -> int:
    """Budget from a setting: absent means the default, anything but a whole number is refused."""
    if text is None:
        return C.DEFAULT_BUDGET
    value = float(text.strip() or 0)
    if value < 0 or value != int(value):
        raise ValueError(f"budget must be a whole number of 0 or more, got {text}")
    return int(value)


def effective_budget(requested: float | None) -> int:
    """Budget a pass works with: unusable values score nothing."""
    if requested is None:
        return C.DEFAULT_BUDGET
    return int(requested) if requested > 0 and requested == int(requested) else 0


def scoring_candidates(
    scores: DataFrame, postings: DataFrame, limit: int, *, rubric_version: str,
    prompt_version: str, profile_version: str, model_id: str,
) -> DataFrame:
    """Passing active rows without a result from the current prompt, profile and model.

    Best retrieval score first, then smaller id. Rows retrieval never reached still qualify.
    """
    current = (
        F.col("prompt_version").eqNullSafe(prompt_version)
        & F.col("profile_version").eqNullSafe(profile_version)
        & F.col("model_id").eqNullSafe(model_id)
    )
    active = postings.where("status = 'active'").select(F.col("id").alias("job_id"))
    return (
        scores.where((F.col("rubric_version") == rubric_version) & F.col("hard_filter_pass"))
        .where(F.col("rubric_score").isNull() | ~current)
        .join(active, "job_id", "left_semi")
        .orderBy(F.desc("retrieval_score"), "job_id").limit(limit)
        .select("job_id", "description_hash", "retrieval_score", "profile_version")
    )


def score_cache(
    scores: DataFrame, *, rubric_version: str, prompt_version: str, profile_version: str,
    model_id: str,
) -> DataFrame:
    """Newest stored result per description hash for one exact scorer configuration."""
    stored = scores.where(
        (F.col("rubric_version") == rubric_version)
        & (F.col("prompt_version") == prompt_version)
        & (F.col("profile_version") == profile_version)
        & (F.col("model_id") == model_id)
        & F.col("rubric_score").isNotNull() & F.col("dimensions").isNotNull()
    )
    best = F.max_by(
        F.struct("rubric_score", "dimensions", "uncertainty", "rationale"),
        F.struct("scored_at", -F.col("job_id")),
    )
    return stored.groupBy("description_hash").agg(best.alias("_r")).select(
        "description_hash", F.col("_r.rubric_score").alias("overall"),
        F.col("_r.dimensions").alias("dimensions"),
        F.coalesce("_r.uncertainty", F.lit("medium")).alias("uncertainty"),
        F.coalesce("_r.rationale", F.lit("")).alias("rationale"),
    )


def cache_hits(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    return candidates.join(cache, "description_hash")


def pending_groups(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache misses, one row per description: the best candidate stands for its group."""
    misses = candidates.join(cache.select("description_hash"), "description_hash", "left_anti")
    return misses.groupBy("description_hash").agg(
        F.min_by("job_id", F.struct(-F.col("retrieval_score"), "job_id")).alias("job_id"),
        F.count("*").alias("group_size"),
    )


def apply_scorer(
    work: DataFrame, scorer: Callable[[pd.Series], dict],
    concurrency: int = C.SCORER_CONCURRENCY,
) -> DataFrame:
    """Run ``scorer`` once per row of ``work`` (description_hash plus whatever it needs).

    The scorer returns overall, dimensions, uncertainty and rationale. One that raises, or returns
    something else, yields an error row and stops nothing. ``concurrency`` partitions run at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                record = {"description_hash": row["description_hash"], "overall": None,
                          "dimensions": None, "uncertainty": None, "rationale": None, "error": None}
                try:
                    record.update(_validated(scorer(row)))
                except Exception as problem:  # one bad posting must not fail the stage
                    record["error"] = str(problem) or type(problem).__name__
                out.append(record)
            yield pd.DataFrame(out, columns=list(_RESULT_COLUMNS))

    raw = work.repartition(concurrency).mapInPandas(run, SCORE_RESULT)
    return raw.withColumns({
        "overall": clamp_overall("overall"), "dimensions": clamp_dimensions("dimensions"),
    })


_RESULT_COLUMNS = ("description_hash", "overall", "dimensions", "uncertainty", "rationale", "error")


def _validated(result: dict) -> dict:
    if result["uncertainty"] not in ("low", "medium", "high"):
        raise ValueError(f"uncertainty is {result['uncertainty']!r}")
    dimensions = {
        name: {
            "score": float(result["dimensions"][name]["score"]),
            "evidence": [str(e) for e in result["dimensions"][name]["evidence"]],
            "note": str(result["dimensions"][name]["note"]),
        }
        for name, _ in C.DIMENSIONS
    }
    return {
        "overall": float(result["overall"]), "dimensions": dimensions,
        "uncertainty": result["uncertainty"], "rationale": str(result["rationale"]),
    }


def scorer_input(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """What a scorer sees of each representative posting."""
    return postings.join(groups.select(F.col("job_id").alias("id")), "id", "left_semi").select(
        F.col("id").alias("job_id"), "description_hash", "company", "title",
        F.coalesce("location", F.lit("not stated")).alias("location"), "remote",
        F.coalesce("salary_text", F.lit("not stated")).alias("salary"), "source", "url",
        "description",
    )


def merge_scores(
    scores: DataFrame, results: DataFrame, candidates: DataFrame, *, rubric_version: str,
    prompt_version: str, profile_version: str, model_id: str, scored_at: Column,
) -> DataFrame:
    """Fan results out by description hash to the candidates and store them with provenance.

    A candidate is one row of one profile: rows of other profiles for the same posting stay.
    """
    good = results.where("overall IS NOT NULL")
    per_job = candidates.select("job_id", "description_hash", "profile_version").join(good, "description_hash").select(
        F.col("job_id").alias("_job"), F.col("profile_version").alias("_profile"),
        F.struct("overall", "dimensions", "uncertainty", "rationale").alias("_r"),
    )
    own = (F.col("job_id") == F.col("_job")) & F.col("profile_version").eqNullSafe(F.col("_profile"))
    joined = scores.join(per_job, own & (F.col("rubric_version") == rubric_version), "left")
    fresh = F.col("_r").isNotNull()
    values = {
        "rubric_score": F.col("_r.overall"), "dimensions": F.col("_r.dimensions"),
        "uncertainty": F.col("_r.uncertainty"), "rationale": F.col("_r.rationale"),
        "prompt_version": F.lit(prompt_version), "profile_version": F.lit(profile_version),
        "model_id": F.lit(model_id), "scored_at": scored_at,
    }
    return joined.select(*[
        F.when(fresh, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in scores.columns
    ])


def funnel_summary(
    verdicts: DataFrame, retrieved: DataFrame, candidates: DataFrame, cache: DataFrame,
    failed_hashes: DataFrame | None = None,
) -> DataFrame:
    """One row: examined, passed, retrieved, scored, cache_hits, errors."""
    groups = pending_groups(candidates, cache)
    if failed_hashes is not None:
        groups = groups.join(
            failed_hashes.select("description_hash", F.lit(True).alias("failed")).distinct(),
            "description_hash", "left",
        )
    else:
        groups = groups.withColumn("failed", F.lit(None).cast("boolean"))
    good = F.col("failed").isNull()
    work = groups.agg(
        F.count_if(good).alias("scored"),
        F.coalesce(F.sum(F.when(good, F.col("group_size") - 1)), F.lit(0)).alias("fanned"),
        F.count_if(~good).alias("errors"),
    ).select(F.struct("scored", "fanned", "errors").alias("w")).scalar()
    hits = cache_hits(candidates, cache).agg(F.count("*")).scalar()
    return verdicts.agg(
        F.count("*").alias("examined"), F.count_if("hard_filter_pass").alias("passed")
    ).withColumns({
        "retrieved": retrieved.agg(F.count("*")).scalar(), "_w": work, "_hits": hits,
    }).select(
        "examined", "passed", "retrieved", F.col("_w.scored").alias("scored"),
        (F.col("_hits") + F.col("_w.fanned")).alias("cache_hits"), F.col("_w.errors").alias("errors"),
    )
