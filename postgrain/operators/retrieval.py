"""Candidate recall over three paths and the weighted retrieval score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.functions.labels import clamp
from postgrain.functions.skills import match_skills
from postgrain.operators.profiles import Profile
from postgrain.operators.text_index import FIELDS, clean_phrases, phrase_scan, rank_scan
from postgrain.rules import constants as C
from postgrain.rules.skills import SKILLS
from postgrain.session import checkpointed

PATHS = ("title", "skill", "company")


def _literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def best_matches(
    ranked: DataFrame, passing: DataFrame, path: str, limit: int | None = None
) -> DataFrame:
    """Passing active postings of a text ranking: all, or the best ``limit``; ties by smaller id.

    Statistics cover every posting, so the filter comes after ranking, as a narrow join.
    """
    found = ranked.withColumnRenamed("doc_id", "job_id").join(passing, "job_id", "left_semi")
    best = found if limit is None else found.orderBy("rank", "job_id").limit(limit)
    return best.select(
        "job_id", F.lit(path).alias("path"),
        clamp(-F.col("rank") / C.TEXT_SCORE_SCALE, 0.0, 1.0).alias("text_score"))


def company_path(postings: DataFrame, passing: DataFrame, companies) -> DataFrame:
    """Every passing active posting of a target company."""
    wanted = postings.where(F.col("company_normalized").isin(*companies) if companies else F.lit(False))
    return wanted.select(F.col("id").alias("job_id")).join(passing, "job_id", "left_semi").select(
        "job_id", F.lit("company").alias("path"), F.lit(0.0).alias("text_score")
    )


def passing_ids(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """Active postings with a passing verdict, each once."""
    active = postings.where("status = 'active'").select(F.col("id").alias("job_id"))
    return active.join(scores.where("hard_filter_pass").select("job_id"), "job_id", "left_semi")


def recall_paths(
    postings: DataFrame, scores: DataFrame, profile: Profile, limit: int | None = None,
    stemmed: bool = True,
) -> DataFrame:
    """Candidates with their recall paths in fixed order and best text score."""
    passing = passing_ids(postings, scores)
    titles, rare = clean_phrases(profile.title_phrases()), clean_phrases(profile.rare_skills)
    phrases = titles + rare
    # both text paths read one scan of the texts
    scan = checkpointed(
        phrase_scan(postings.select(F.col("id").alias("doc_id"), *FIELDS), phrases, stemmed=stemmed)
    )
    by_title = rank_scan(scan, phrases, range(len(titles)))
    by_skill = rank_scan(scan, phrases, range(len(titles), len(phrases)))
    hits = best_matches(by_title, passing, "title", limit).unionByName(
        best_matches(by_skill, passing, "skill", limit)
    ).unionByName(company_path(postings, passing, profile.target_companies))
    order = _literal_array(PATHS)
    grouped = hits.groupBy("job_id").agg(
        F.max("text_score").alias("text_score"), F.collect_set("path").alias("_paths")
    )
    return grouped.select(
        "job_id", "text_score",
        F.filter(order, lambda p: F.array_contains("_paths", p)).alias("recall_paths"),
    )


def family_score(family: Column | str, profile: Profile) -> Column:
    """1 for the first target family, sloping to just above one half for the last; 0 otherwise."""
    column = F.col(family) if isinstance(family, str) else family
    place = F.coalesce(F.array_position(_literal_array(profile.target_families), column), F.lit(0))
    slope = (place - 1) / F.lit(max(1, len(profile.target_families))) * 0.5
    return F.when(place == 0, F.lit(0.0)).otherwise(1 - slope)


def coverage(found: Column, wanted, denominator: int) -> Column:
    shared = F.size(F.array_intersect(found, _literal_array(wanted)))
    return clamp(shared / F.lit(float(denominator)), 0.0, 1.0)


def score_candidates(
    postings: DataFrame, candidates: DataFrame, profile: Profile, skills=SKILLS
) -> DataFrame:
    """Candidates with each feature and the retrieval score, 0..100."""
    found = match_skills(F.concat("title", F.lit("\n"), "description"), skills)
    features = postings.withColumnRenamed("id", "job_id").join(candidates, "job_id").select(
        "job_id", "text_score", "recall_paths",
        family_score("title_family", profile).alias("family_score"),
        found.alias("_found"),
        F.col("company_normalized").isin(*profile.target_companies).alias("company_match")
        if profile.target_companies else F.lit(False).alias("company_match"),
    )
    scored = features.select(
        "job_id", "recall_paths", "text_score", "family_score", "company_match",
        coverage(F.col("_found"), profile.skills,
                 max(1, min(len(profile.skills), C.SKILL_DENOMINATOR_CAP))).alias("skill_coverage"),
        coverage(F.col("_found"), profile.rare_skills,
                 max(1, len(profile.rare_skills))).alias("rare_coverage"),
    )
    total = (
        C.WEIGHT_FAMILY * F.col("family_score") + C.WEIGHT_SKILL * F.col("skill_coverage")
        + C.WEIGHT_RARE * F.col("rare_coverage")
        + C.WEIGHT_COMPANY * F.col("company_match").cast("double")
        + C.WEIGHT_TEXT * F.col("text_score")
    )
    return scored.withColumn("retrieval_score", 100 * clamp(total, 0.0, 1.0))


def retrieve(
    postings: DataFrame, scores: DataFrame, profile: Profile, limit: int | None = None,
    recall_limit: int | None = None, stemmed: bool = True,
) -> DataFrame:
    """Scored candidates, best first; all of them unless ``limit`` is given."""
    candidates = recall_paths(postings, scores, profile, recall_limit, stemmed)
    ranked = score_candidates(postings, candidates, profile)
    return top_candidates(ranked, limit)


def top_candidates(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = ranked.orderBy(F.desc("retrieval_score"), "job_id")
    return ordered if limit is None else ordered.limit(limit)


def merge_retrieval(
    scores: DataFrame, candidates: DataFrame, rubric_version: str, profile_version: str
) -> DataFrame:
    """Write score and paths of the candidates; every other row keeps its old values."""
    new = candidates.select(
        "job_id", F.col("retrieval_score").alias("_score"), F.col("recall_paths").alias("_paths"),
        F.lit(rubric_version).alias("rubric_version"),
        F.lit(profile_version).alias("profile_version"),
    )
    return scores.join(new, ["job_id", "rubric_version", "profile_version"], "left").withColumns({
        "retrieval_score": F.coalesce("_score", "retrieval_score"),
        "recall_paths": F.coalesce("_paths", "recall_paths"),
    }).select(*scores.columns)
