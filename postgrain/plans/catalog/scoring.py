"""Budgeted scoring, caches and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from postgrain.operators import extraction as E
from postgrain.operators import scoring as C
from postgrain.plans import bindings as B
from postgrain.plans import sqltext as S
from postgrain.plans.registry import query
from postgrain.rules.constants import DIMENSIONS
from postgrain.session import read_table

_NOW = dict(rubric_version="rubric-v1", prompt_version="v2", profile_version="p1", model_id="m1")
_CANDIDATES = """candidates AS MATERIALIZED (
  SELECT s.job_id, s.description_hash, s.retrieval_score, s.profile_version FROM scores_once s
  JOIN jobs_once p ON p.id = s.job_id AND p.status = 'active'
  WHERE s.hard_filter_pass AND (s.rubric_score IS NULL OR s.prompt_version IS DISTINCT FROM 'v2'
    OR s.profile_version IS DISTINCT FROM 'p1' OR s.model_id IS DISTINCT FROM 'm1')
  ORDER BY s.retrieval_score DESC, s.job_id LIMIT 250
), cache AS (
  SELECT description_hash, arg_max(job_id, {'a': scored_at, 'b': -job_id}) AS best FROM scores_once
  WHERE prompt_version = 'v2' AND profile_version = 'p1' AND model_id = 'm1' AND rubric_score IS NOT NULL
  GROUP BY description_hash
), pending AS MATERIALIZED (
  SELECT description_hash, arg_min(job_id, {'a': -retrieval_score, 'b': job_id}) AS job_id,
    count(*) AS group_size
  FROM candidates WHERE description_hash NOT IN (SELECT description_hash FROM cache) GROUP BY description_hash
)"""
# each table once, however often it is named below
_ONCE = """jobs_once AS MATERIALIZED (SELECT id, description_hash, description, status FROM postings),
scores_once AS MATERIALIZED (SELECT * FROM scores)"""
_BASE = S.with_(S.POSTINGS, S.SCORES, _ONCE, _CANDIDATES)


def _parts(spark, sf):
    scores = B.scores(spark, sf)
    candidates = C.scoring_candidates(scores, B.postings(spark, sf).select("id", "status"), 250, **_NOW)
    return scores, candidates, C.score_cache(scores, **_NOW)


@query("scoring_candidates", _BASE + "SELECT * FROM candidates")
def scoring_candidates(spark, sf):
    return _parts(spark, sf)[1]


@query("cache_hits", _BASE + """
SELECT c.job_id, s.rubric_score AS overall, coalesce(s.uncertainty, 'medium') AS uncertainty,
  coalesce(s.rationale, '') AS rationale
FROM candidates c JOIN cache k USING (description_hash) JOIN scores_once s ON s.job_id = k.best""")
def cache_hits(spark, sf):
    _, candidates, cache = _parts(spark, sf)
    return C.cache_hits(candidates, cache).select("job_id", "overall", "uncertainty", "rationale")


@query("hash_fan_out", _BASE + "SELECT * FROM pending")
def hash_fan_out(spark, sf):
    _, candidates, cache = _parts(spark, sf)
    return C.pending_groups(candidates, cache)


def length_scorer(row) -> dict:
    """A deterministic stand-in for a scoring model."""
    n = len(row["description"])
    if n % 7 == 0:
        raise ValueError(f"refused {n}")
    return {
        "overall": n % 130 + 0.5,
        "dimensions": {
            name: {"score": n % 14 - 1, "evidence": [str(n)] * 5, "note": name} for name, _ in DIMENSIONS
        },
        "uncertainty": ("low", "medium", "high")[n % 3], "rationale": f"{n} characters",
    }


_HOOK = """work AS MATERIALIZED (
  SELECT g.description_hash, length(p.description) AS n
  FROM pending g JOIN jobs_once p ON p.id = g.job_id
)"""
_OVERALL = "CAST(floor(least(100.0, n % 130 + 0.5) + 0.5) AS DOUBLE)"


def _scored(spark, sf):
    scores, candidates, cache = _parts(spark, sf)
    groups = C.pending_groups(candidates, cache)
    work = C.scorer_input(B.postings(spark, sf), groups)
    return scores, candidates, cache, C.apply_scorer(work, length_scorer)


@query("scored_by_hook", _BASE.rstrip() + ", " + _HOOK + f"""
SELECT description_hash, CASE WHEN n % 7 <> 0 THEN {_OVERALL} END AS overall,
  CASE WHEN n % 7 <> 0 THEN least(10.0, greatest(0.0, n % 14 - 1)) END AS comp_signal,
  CASE WHEN n % 7 <> 0 THEN 3 END AS evidence, CASE WHEN n % 7 = 0 THEN 'refused ' || n END AS error FROM work""")
def scored_by_hook(spark, sf):
    results = _scored(spark, sf)[3]
    return results.select(
        "description_hash", "overall", F.col("dimensions.compSignal.score").alias("comp_signal"),
        F.when(F.col("dimensions").isNotNull(), F.size("dimensions.compSignal.evidence"))
        .alias("evidence"), "error")


@query("merge_scores", _BASE.rstrip() + ", " + _HOOK + f""", results AS (
  SELECT c.job_id, c.profile_version, {_OVERALL.replace('n %', 'w.n %')} AS overall FROM candidates c JOIN work w USING (description_hash)
  WHERE w.n % 7 <> 0
)
SELECT s.job_id, coalesce(r.overall, s.rubric_score) AS rubric_score,
  CASE WHEN r.job_id IS NOT NULL THEN 'm1' ELSE s.model_id END AS model_id,
  CASE WHEN r.job_id IS NOT NULL THEN 'p1' ELSE s.profile_version END AS profile_version
FROM scores_once s LEFT JOIN results r ON r.job_id = s.job_id
  AND r.profile_version IS NOT DISTINCT FROM s.profile_version""")
def merge_scores(spark, sf):
    scores, candidates, _, results = _scored(spark, sf)
    return C.merge_scores(
        scores, results, candidates, **_NOW, scored_at=F.lit("2024-06-01").cast("timestamp")
    ).select("job_id", "rubric_score", "model_id", "profile_version")


@query("funnel_summary", _BASE.rstrip() + ", " + _HOOK + """
SELECT (SELECT count(*) FROM scores_once) AS examined, (SELECT count(*) FROM scores_once WHERE hard_filter_pass) AS passed,
  (SELECT count(*) FROM scores_once WHERE retrieval_score > 50) AS retrieved,
  (SELECT count(*) FROM work WHERE n % 7 <> 0) AS scored,
  (SELECT count(*) FROM candidates JOIN cache USING (description_hash))
    + (SELECT CAST(coalesce(sum(group_size - 1), 0) AS BIGINT) FROM pending JOIN work USING (description_hash)
       WHERE n % 7 <> 0) AS cache_hits,
  (SELECT count(*) FROM work WHERE n % 7 = 0) AS errors""")
def funnel_summary(spark, sf):
    scores, candidates, cache, results = _scored(spark, sf)
    return C.funnel_summary(
        scores, scores.where("retrieval_score > 50"), candidates, cache, results.where("error IS NOT NULL"))


_COMMENTS = """spoken AS (
  SELECT conv_id % 40 AS thread_id, conv_id * 1000 + turn AS comment_id, text,
    row_number() OVER (PARTITION BY conv_id % 40 ORDER BY conv_id * 1000 + turn) AS place
  FROM conversations WHERE trim(text) <> ''
), pending AS (
  SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY comment_id) AS n FROM spoken
  WHERE comment_id % 4 <> 0
)"""


def _comments(spark, sf):
    c = read_table(spark, sf, "conversations")
    ident = F.col("conv_id") * 1000 + F.col("turn")
    return E.thread_comments(c.select(
        (F.col("conv_id") % 40).alias("thread_id"), ident.alias("comment_id"), ident.alias("position"), "text"))


def _pending(spark, sf):
    comments = _comments(spark, sf)
    cache = comments.where("comment_id % 4 = 0").select(
        "comment_id", F.lit("v2").alias("prompt_version")
    ).unionByName(comments.select("comment_id", F.lit("v1").alias("prompt_version")))
    return E.pending_batches(comments, cache, "v2")


@query("pending_threads", S.with_(_COMMENTS) + """
SELECT thread_id, comment_id, CAST((n - 1) // 5 AS BIGINT) AS batch_no FROM pending""")
def pending_threads(spark, sf):
    return _pending(spark, sf).select("thread_id", "comment_id", "batch_no")


def first_word_extractor(batch) -> dict:
    """Deterministic stand-in: a posting per comment, none for ids divisible by five."""
    if any(int(i) % 11 == 0 for i, _ in batch):
        raise ValueError("batch refused")
    return {
        i: [{"company": text.split()[0], "title": "t", "location": None, "remote": False,
             "salaryText": None, "url": None, "summary": "s"}]
        for i, text in batch if int(i) % 5
    }


@query("extracted_threads", S.with_(_COMMENTS) + """
, failed AS (SELECT DISTINCT thread_id, (n - 1) // 5 AS b FROM pending WHERE comment_id % 11 = 0)
SELECT CAST(p.comment_id AS VARCHAR) AS comment_id, f.b IS NOT NULL AS failed,
  CASE WHEN f.b IS NOT NULL THEN NULL WHEN p.comment_id % 5 = 0 THEN 0 ELSE 1 END AS postings
FROM pending p LEFT JOIN failed f ON f.thread_id = p.thread_id AND f.b = (p.n - 1) // 5""")
def extracted_threads(spark, sf):
    return E.extract_batches(_pending(spark, sf), first_word_extractor, "v2").select(
        "comment_id", F.col("error").isNotNull().alias("failed"),
        F.when(F.col("postings").isNotNull(), F.size("postings")).alias("postings"))


def _inventory(spark, sf):
    docs = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("title"))
    keyed = E.document_keys(docs, "v1", "m")
    cache = keyed.where("id % 3 <> 0").groupBy("cache_key").agg(F.min("id").alias("d")).select(
        "cache_key", F.array(F.concat(F.lit(" Skill "), (F.col("d") % 50).cast("string")), F.lit(" ")).alias("skills"),
        F.array(F.struct(F.concat(F.lit("Proof "), (F.col("d") % 9).cast("string")).alias("skill"),
                         F.lit("x").alias("detail"))).alias("evidence"),
    ).unionByName(spark.createDataFrame(
        [("stale", ["gone"], [("gone", "x")])],
        "cache_key string, skills array<string>, evidence array<struct<skill:string,detail:string>>"))
    return keyed, cache


_INVENTORY = """keyed AS (SELECT doc_id AS id, source AS title, sha256(text || '|v1|m') AS cache_key FROM documents),
cached AS (SELECT cache_key, min(id) AS d FROM keyed WHERE id % 3 <> 0 GROUP BY cache_key)"""


@query("skill_inventory", S.with_(_INVENTORY) + """
SELECT DISTINCT 'skill ' || (d % 50) AS skill FROM cached UNION SELECT 'proof ' || (d % 9) FROM cached""")
def skill_inventory(spark, sf):
    return E.skill_inventory(*_inventory(spark, sf))


@query("inventory_upkeep", S.with_(_INVENTORY) + """
SELECT 'omitted' AS what, count(*) AS n FROM keyed WHERE cache_key NOT IN (SELECT cache_key FROM cached)
UNION ALL SELECT 'kept', count(*) FROM cached
UNION ALL SELECT 'evidence', count(*) FROM keyed JOIN cached USING (cache_key)""")
def inventory_upkeep(spark, sf):
    keyed, cache = _inventory(spark, sf)

    def count(df, what):
        return df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")

    return (count(E.omitted_documents(keyed, cache), "omitted")
            .unionByName(count(E.pruned_cache(keyed, cache), "kept"))
            .unionByName(count(E.inventory_evidence(keyed, cache), "evidence")))


_LOCAL = """local_ AS (SELECT s_suppkey AS k, 'Repo-' || s_suppkey AS name,
  CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Me/Repo-' || (s_suppkey + 7) ELSE 'them/x' || s_suppkey END AS remote
  FROM supplier), known AS (SELECT 'repo-' || s_suppkey AS name FROM supplier WHERE s_suppkey % 4 = 0),
kept AS (SELECT * FROM local_ WHERE lower(name) NOT IN (SELECT name FROM known)
  AND (remote IS NULL OR lower(split_part(remote, '/', 2)) NOT IN (SELECT name FROM known)))"""


def _local(spark, sf):
    k = F.col("s_suppkey")
    s = read_table(spark, sf, "supplier")
    local = s.select(
        k.alias("k"), F.concat(F.lit("Repo-"), k.cast("string")).alias("name"),
        F.when(k % 3 == 0, F.lit(None)).when(
            k % 3 == 1, F.concat(F.lit("Me/Repo-"), (k + 7).cast("string")))
        .otherwise(F.concat(F.lit("them/x"), k.cast("string"))).alias("remote"))
    names = s.where("s_suppkey % 4 = 0").select(F.concat(F.lit("REPO-"), k.cast("string")).alias("name"))
    return local, E.local_inventory(local, names)


@query("inventory_dedupe", S.with_(_LOCAL) + "SELECT k, name FROM kept")
def inventory_dedupe(spark, sf):
    return _local(spark, sf)[1].select("k", "name")


@query("inventory_composition", S.with_(_LOCAL) + """
SELECT (SELECT count(*) FROM local_) AS total, count(*) AS kept, (SELECT count(*) FROM local_) - count(*) AS duplicates,
  count(*) FILTER (WHERE remote LIKE 'Me/%') AS owned, count(*) FILTER (WHERE remote IS NULL) AS no_remote,
  count(*) FILTER (WHERE remote LIKE 'them/%') AS foreign_owned FROM kept""")
def inventory_composition(spark, sf):
    local, kept = _local(spark, sf)
    return E.inventory_composition(local, kept, ["me"])


@query("merged_profiles", """
WITH have AS (SELECT n_nationkey AS k, 'v' || n_nationkey AS version, n_name FROM nation),
found AS (SELECT 'v' || c_nationkey AS version, lower(c_mktsegment) AS s FROM customer),
merged AS (SELECT h.version, list_sort(list_distinct(list_concat(['sql', lower(h.n_name)],
  coalesce((SELECT list(s) FROM found f WHERE f.version = h.version), [])))) AS skills FROM have h)
SELECT version, array_to_string(skills, ',') AS skills,
  substr(sha256(version || '|["' || array_to_string(skills, '","') || '"]'), 1, 12) AS new_version FROM merged""")
def merged_profiles(spark, sf):
    profiles = read_table(spark, sf, "nation").select(
        F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("version"),
        F.array(F.lit("sql"), F.lower("n_name")).alias("skills"))
    found = read_table(spark, sf, "customer").select(
        F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("version"),
        F.concat(F.lit(" "), F.col("c_mktsegment")).alias("skill"))
    return E.merged_profile_rows(profiles, found).withColumn("skills", F.array_join("skills", ","))
