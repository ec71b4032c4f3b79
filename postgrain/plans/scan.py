"""One pipeline run from landed items to scored postings, each stage a DataFrame.

land -> flatten -> clean -> resolve -> upsert -> sweep -> filter -> retrieve -> score
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.operators import filters, lifecycle, retrieval, scoring
from postgrain.operators.identity import resolve_identity
from postgrain.operators.normalize import normalize
from postgrain.operators.profiles import Profile
from postgrain.rules.constants import RUBRIC_VERSION
from postgrain.schemas import DIMENSIONS
from postgrain.session import checkpointed

SCORES = (
    "job_id bigint, description_hash string, rubric_version string, profile_version string, "
    "hard_filter_pass boolean, reasons array<string>, retrieval_score double, "
    f"recall_paths array<string>, rubric_score double, dimensions {DIMENSIONS}, uncertainty string, "
    "rationale string, "
    "prompt_version string, model_id string, scored_at timestamp"
)


@dataclass
class Collected:
    postings: DataFrame
    identities: DataFrame


def collect(
    existing: DataFrame, items: DataFrame, walks: DataFrame, started_at: Column, seen_at: Column
) -> Collected:
    """Fold one run's raw items into the stored postings.

    ``existing`` has the posting columns with seq, id, canonical_id and lifecycle; ``items`` are
    raw items with seq, numbered after the stored rows. ``walks`` has one row per fetched source:
    (source, covered_since), covered_since being null where the whole feed was read.
    """
    batch = normalize(items).withColumn("seen_at", seen_at)
    identities = checkpointed(resolve_identity(existing, batch))
    named = batch.join(identities.select("seq", "canonical_id"), "seq").withColumn(
        # a stable key: the natural key hashed, so a re-run mints the same id
        "id", F.xxhash64("source", "source_native_id")
    ).withColumn("_first_seq", F.col("seq"))
    kept = existing.withColumn("_first_seq", F.col("seq")).drop("seq")
    merged = lifecycle.upsert_postings(kept, named).withColumnRenamed("_first_seq", "seq")
    plan = walks.withColumn("started_at", started_at)
    return Collected(lifecycle.sweep_missing(merged, plan), identities)


def score(
    postings: DataFrame, scores: DataFrame, profile: Profile, scorer: Callable, *,
    prompt_version: str, model_id: str, now: Column, budget: float | None = None,
    rubric_version: str = RUBRIC_VERSION, stemmed: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Refresh verdicts, retrieval and, within the budget, rubric scores of one profile.

    Returns the new score table and the funnel summary. The cheap stages come first, so the scorer
    sees only passing postings, once per description.
    """
    config = dict(rubric_version=rubric_version, prompt_version=prompt_version,
                  profile_version=profile.version, model_id=model_id)
    verdicts = filters.hard_filter_verdicts(postings, [profile]).withColumns({
        "rubric_version": F.lit(rubric_version), "scored_at": now})
    judged = checkpointed(filters.merge_verdicts(scores, verdicts))
    found = checkpointed(retrieval.retrieve(
        postings, judged.where(F.col("profile_version") == profile.version), profile, stemmed=stemmed))
    ranked = checkpointed(
        retrieval.merge_retrieval(judged, found, rubric_version, profile.version))
    mine = ranked.where(F.col("profile_version") == profile.version)
    candidates = checkpointed(scoring.scoring_candidates(
        mine, postings, scoring.effective_budget(budget), **config))
    cache = scoring.score_cache(ranked, **config)
    work = scoring.scorer_input(postings, scoring.pending_groups(candidates, cache))
    # the scorer is the expensive stage: its results are stored before anything reads them
    results = checkpointed(scoring.apply_scorer(work, scorer))
    known = scoring.cache_hits(candidates, cache).select(
        "description_hash", "overall", "dimensions", "uncertainty", "rationale").distinct()
    every = results.where("error IS NULL").select(*known.columns).unionByName(known)
    final = scoring.merge_scores(ranked, every, candidates, **config, scored_at=now)
    summary = scoring.funnel_summary(
        verdicts, found, candidates, cache, results.where("error IS NOT NULL"))
    return final, summary
