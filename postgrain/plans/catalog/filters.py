"""Explained filters over postings and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from postgrain.operators import filters as FL
from postgrain.plans import bindings as B
from postgrain.plans import sqltext as S
from postgrain.plans.registry import query
from postgrain.rules import places as P
from postgrain.rules.constants import SENIORITY_LEVELS


def _words_like(padded: str, phrases) -> str:
    hits = [f"contains({padded}, {S.lit(' ' + p + ' ')})" for p in phrases]
    return "(" + (" OR ".join(hits) if hits else "false") + ")"


def _place_sql(profile) -> str:
    """Location rule written over padded word strings and plain regexes."""
    accepted = profile.accepted_locations

    def pad(text: str) -> str:
        return f"(' ' || trim(regexp_replace({text}, '[^a-z]+', ' ', 'g')) || ' ')"

    def narrowed(text: str) -> str:
        # two passes, because removing a word uses up the blank shared with its neighbour
        generic = f"' ({'|'.join(P.GENERIC_REMOTE)}) '"
        once = f"regexp_replace({pad(text)}, {generic}, '  ', 'g')"
        return pad(f"regexp_replace({once}, {generic}, '  ', 'g')")

    single = "|".join(r for r in P.US_REGIONS if " " not in r)
    double = "|".join(r for r in P.US_REGIONS if " " in r)

    def us_region(padded: str) -> str:
        return f"(regexp_matches({padded}, ' ({single}) ') OR regexp_matches({padded}, '^ ({double}) $'))"

    us = (f"(regexp_matches({pad('loc')}, ' (us|usa|united states|{'|'.join(P.US_STATES)}) ') OR "
          f"regexp_matches(replace(loc, '.', ''), '(^|[^a-z])({'|'.join(P.US_CODES)})"
          "([^a-z]*$|[^a-z]*[,/|;]|[^a-z]*\\s[-–—]\\s)'))")
    parts = ("list_filter(list_transform(string_split(replace(loc, '/', ','), ','), lambda q: trim(q)), "
             "lambda q: q <> '')")
    part_ok = (f"len(list_filter({parts}, lambda q: {us_region(pad('q'))} OR "
               f"(trim({narrowed('q')}) <> '' AND {_words_like(narrowed('q'), accepted)}))) > 0")
    anywhere = _words_like(pad("loc"), accepted)
    return f"""CASE WHEN loc = '' THEN remote WHEN {us} THEN true
      WHEN remote AND trim({narrowed('loc')}) = '' THEN true
      WHEN remote AND len({parts}) > 1 THEN {part_ok}
      WHEN remote AND contains({pad('loc')}, ' remote ') THEN
        {us_region(narrowed('loc'))} OR {_words_like(narrowed('loc'), accepted)}
      ELSE {anywhere} END"""


def _verdict_sql(profile) -> str:
    low, high = (SENIORITY_LEVELS.index(x) for x in (profile.seniority_min, profile.seniority_max))
    rank = S.rank("seniority")
    auth = ", ".join(
        f"CASE WHEN {S.like('description', '(?i)' + p)} THEN {S.lit('work-auth:' + label)} END"
        for label, p in P.WORK_AUTH_PATTERNS)
    targets = ", ".join(S.lit(f) for f in profile.target_families)
    return f"""SELECT id AS job_id, {S.lit(profile.version)} AS profile_version, description_hash,
    list_filter([{auth},
      CASE WHEN title_family IS NULL THEN 'role-family:unclassified'
        WHEN title_family NOT IN ({targets}) THEN 'role-family:' || title_family END,
      CASE WHEN {rank} < {low} THEN 'seniority-below:' || seniority END,
      CASE WHEN {rank} > {high} THEN 'seniority-above:' || seniority END,
      CASE WHEN {str(profile.remote_only).lower()} AND NOT remote THEN 'remote-only' END,
      CASE WHEN NOT ({_place_sql(profile)}) THEN 'location:' || lower(coalesce(location, 'unspecified')) END
    ], lambda r: r IS NOT NULL) AS reasons FROM live"""


VERDICTS = (
    "live AS (SELECT *, lower(coalesce(location, '')) AS loc FROM postings WHERE status = 'active'),\n"
    "verdicts AS (" + "\nUNION ALL\n".join(_verdict_sql(p) for p in B.PROFILES) + ")"
)


@query("hard_filter_verdicts", S.with_(S.POSTINGS, VERDICTS) + f"""
SELECT job_id, profile_version, {S.joined('reasons', ' | ')} AS reasons, len(reasons) = 0 AS hard_filter_pass
FROM verdicts""")
def hard_filter_verdicts(spark, sf):
    return FL.hard_filter_verdicts(B.postings(spark, sf), list(B.PROFILES)).select(
        "job_id", "profile_version", F.array_join("reasons", " | ").alias("reasons"), "hard_filter_pass")


@query("rule_table_verdicts", S.with_(S.POSTINGS, VERDICTS) + f"""
SELECT job_id, profile_version, {S.joined('reasons', ' | ')} AS reasons, len(reasons) = 0 AS hard_filter_pass
FROM verdicts""")
def rule_table_verdicts(spark, sf):
    """The same by the way that long lists of profiles take."""
    rules = FL.profile_rules(spark, list(B.PROFILES))
    return FL.verdicts_by_table(B.postings(spark, sf), rules).select(
        "job_id", "profile_version", F.array_join("reasons", " | ").alias("reasons"), "hard_filter_pass")


@query("filter_reason_counts", S.with_(S.POSTINGS, VERDICTS) + """
SELECT profile_version, reason, count(*) AS postings
FROM (SELECT profile_version, unnest(reasons) AS reason FROM verdicts) GROUP BY ALL""")
def filter_reason_counts(spark, sf):
    return FL.reason_counts(FL.hard_filter_verdicts(B.postings(spark, sf), list(B.PROFILES)))


_NEW = """fresh AS (
  SELECT job_id, rubric_version, profile_version, job_id % 4 <> 0 AS pass,
    CASE WHEN job_id % 3 = 0 THEN sha256('changed') ELSE description_hash END AS hash
  FROM scores WHERE job_id % 5 <> 0
  UNION ALL SELECT job_id, rubric_version, 'p9', true, description_hash FROM scores WHERE job_id % 10 = 0
)"""


@query("merge_verdicts", S.with_(S.SCORES, _NEW) + """
SELECT coalesce(s.job_id, f.job_id) AS job_id, coalesce(s.profile_version, f.profile_version) AS profile_version,
  CASE WHEN f.job_id IS NULL THEN s.hard_filter_pass ELSE f.pass END AS hard_filter_pass,
  CASE WHEN f.job_id IS NULL THEN s.reasons ELSE CASE WHEN f.pass THEN '' ELSE 'x' END END AS reasons,
  CASE WHEN f.job_id IS NULL OR s.description_hash = f.hash THEN s.rubric_score END AS rubric_score,
  CASE WHEN f.job_id IS NULL OR s.description_hash = f.hash THEN s.rationale END AS rationale,
  s.prompt_version, coalesce(f.hash, s.description_hash) AS description_hash,
  coalesce(s.retrieval_score, 0.0) AS retrieval_score
FROM scores s FULL OUTER JOIN fresh f ON s.job_id = f.job_id AND s.rubric_version = f.rubric_version
  AND s.profile_version = f.profile_version""")
def merge_verdicts(spark, sf):
    scores = B.scores(spark, sf)
    j = F.col("job_id")
    keys = scores.select("job_id", "rubric_version", "profile_version", "description_hash")
    update = keys.where(j % 5 != 0).withColumns({
        "hard_filter_pass": j % 4 != 0,
        "description_hash": F.when(j % 3 == 0, F.sha2(F.lit("changed"), 256)).otherwise(
            F.col("description_hash")),
    })
    added = keys.where(j % 10 == 0).withColumns({
        "profile_version": F.lit("p9"), "hard_filter_pass": F.lit(True)})
    fresh = update.unionByName(added).withColumns({
        "reasons": F.when(F.col("hard_filter_pass"), F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("x"))),
        "scored_at": F.lit("2024-03-01").cast("timestamp"),
    })
    merged = FL.merge_verdicts(scores, fresh)
    return merged.select(
        "job_id", "profile_version", "hard_filter_pass", F.array_join("reasons", " | ").alias("reasons"),
        "rubric_score", "rationale", "prompt_version", "description_hash", "retrieval_score")
