"""Full-text statistics, recall paths and retrieval scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from postgrain.functions.stemming import porter_stem, stem_expression
from postgrain.operators import retrieval as R
from postgrain.operators import text_index as T
from postgrain.plans import bindings as B
from postgrain.plans import sqltext as S
from postgrain.plans.registry import query
from postgrain.session import read_table

_PROFILE = B.PROFILES[0]
_TITLES = T.clean_phrases(_PROFILE.title_phrases())
_RARE = T.clean_phrases(_PROFILE.rare_skills)
_DOC_PHRASES = ("the", "of the", "der", "la", "and the", "que")


def _tokens_sql(rows: str, key: str, fields, stemmed: bool = False) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {key} AS doc_id, {n} AS field, "
        f"regexp_extract_all(strip_accents(lower(coalesce({f}, ''))), '[\\p{{L}}\\p{{N}}]+') AS t FROM {rows}"
        for n, f in enumerate(fields))
    tokens = f"SELECT doc_id, field, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM ({parts})"
    before = ""
    if stemmed:
        before = f"split AS MATERIALIZED ({tokens}), "
        tokens = f"""SELECT doc_id, field, pos, stem AS token FROM split JOIN (
  SELECT token, {stem_expression('token', S.lit)} AS stem FROM (SELECT DISTINCT token FROM split)) USING (token)"""
    return f"""{before}tokens AS MATERIALIZED (
  {tokens}
), lengths AS (SELECT b.{key} AS doc_id, count(t.token) AS dl FROM {rows} b LEFT JOIN tokens t
  ON t.doc_id = b.{key} GROUP BY b.{key}),
corpus AS (SELECT count(*) AS n, sum(dl) * 1.0 / count(*) AS avgdl FROM lengths)"""


def _phrases_sql(phrases, stemmed: bool = False) -> str:
    """Phrase occurrences by joining tokens position by position."""
    arms = []
    for number, phrase in enumerate(phrases):
        words = [porter_stem(w) if stemmed else w for *_, w in T.query_words([phrase])]
        joins = "".join(
            f" JOIN tokens t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.field = t0.field "
            f"AND t{i}.pos = t0.pos + {i} AND t{i}.token = {S.lit(w)}"
            for i, w in enumerate(words) if i)
        arms.append(f"SELECT t0.doc_id, {number} AS phrase, count(*) AS tf FROM tokens t0{joins} "
                    f"WHERE t0.token = {S.lit(words[0])} GROUP BY t0.doc_id")
    return "freq AS (" + "\nUNION ALL ".join(arms) + ")"


def _bm25(name: str, where: str = "true") -> str:
    return f"""{name} AS (
  SELECT f.doc_id, -sum(greatest(ln((c.n - d.df + 0.5) / (d.df + 0.5)), 1e-6)
      * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * l.dl / c.avgdl))) AS rank
  FROM freq f JOIN (SELECT phrase, count(*) AS df FROM freq GROUP BY phrase) d USING (phrase)
  JOIN lengths l ON l.doc_id = f.doc_id, corpus c WHERE {where} GROUP BY f.doc_id
)"""


_DOCS = S.with_("docs AS (SELECT doc_id, text FROM documents)", _tokens_sql("docs", "doc_id", ["text"]),
                _phrases_sql(_DOC_PHRASES))


@query("term_statistics", S.with_("docs AS (SELECT doc_id, text FROM documents)",
                                  _tokens_sql("docs", "doc_id", ["text"])) + """
SELECT token AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tokens GROUP BY token""")
def term_statistics(spark, sf):
    return T.term_statistics(read_table(spark, sf, "documents").select("doc_id", "text"), ["text"])


@query("term_index", S.with_("docs AS (SELECT doc_id, text FROM documents)",
                             _tokens_sql("docs", "doc_id", ["text"])) + """
SELECT doc_id, token AS term, count(*) AS tf FROM tokens GROUP BY doc_id, token""")
def term_index(spark, sf):
    return T.term_index(read_table(spark, sf, "documents").select("doc_id", "text"), ["text"])


@query("phrase_frequencies", _DOCS + """
SELECT f.doc_id, f.phrase, f.tf, l.dl FROM freq f JOIN lengths l ON l.doc_id = f.doc_id""")
def phrase_frequencies(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return T.phrase_frequencies(T.phrase_scan(docs, _DOC_PHRASES, ["text"], stemmed=False), _DOC_PHRASES)


@query("bm25_rank", _DOCS.rstrip() + ", " + _bm25("ranked") + "SELECT doc_id, round(rank, 6) AS rank FROM ranked")
def bm25_rank(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return T.bm25(docs, _DOC_PHRASES, ["text"], stemmed=False).withColumn("rank", F.round("rank", 6))


_STEMMED_PHRASES = ("les", "the and", "heading", "of the")


@query("bm25_stemmed", S.with_(
    "docs AS (SELECT doc_id, text FROM documents)", _tokens_sql("docs", "doc_id", ["text"], stemmed=True),
    _phrases_sql(_STEMMED_PHRASES, stemmed=True), _bm25("ranked")) + "SELECT doc_id, round(rank, 6) AS rank FROM ranked")
def bm25_stemmed(spark, sf):
    """The same with stemmed words; a test also compares it with SQLite's full-text module."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return T.bm25(docs, _STEMMED_PHRASES, ["text"]).withColumn("rank", F.round("rank", 6))


_TEXT = (_tokens_sql("postings", "id", T.FIELDS, stemmed=True), _phrases_sql(_TITLES + _RARE, stemmed=True),
         _bm25("by_title", f"phrase < {len(_TITLES)}"), _bm25("by_skill", f"phrase >= {len(_TITLES)}"))
_PATHS = """passing AS (
  SELECT id FROM postings WHERE status = 'active' AND id IN (SELECT job_id FROM scores WHERE hard_filter_pass)
), hits AS (
  SELECT * FROM (SELECT doc_id AS job_id, 1 AS path, rank FROM by_title WHERE doc_id IN (SELECT id FROM passing))
  UNION ALL SELECT * FROM (SELECT doc_id, 2, rank FROM by_skill WHERE doc_id IN (SELECT id FROM passing))
  UNION ALL SELECT id, 3, 0.0 FROM postings WHERE id IN (SELECT id FROM passing)
    AND company_normalized IN (""" + ", ".join(map(S.lit, _PROFILE.target_companies)) + """)
), candidates AS (
  SELECT job_id, max(least(1.0, greatest(0.0, -rank / 20))) AS text_score,
    string_agg(CASE path WHEN 1 THEN 'title' WHEN 2 THEN 'skill' ELSE 'company' END, ',' ORDER BY path)
      AS recall_paths
  FROM hits GROUP BY job_id
)"""
_BASE = S.with_(S.POSTINGS, S.SCORES, *_TEXT, _PATHS)


@query("recall_paths", _BASE + "SELECT job_id, round(text_score, 6) AS text_score, recall_paths FROM candidates")
def recall_paths(spark, sf):
    return R.recall_paths(B.postings(spark, sf), B.scores(spark, sf), _PROFILE).select(
        "job_id", F.round("text_score", 6).alias("text_score"),
        F.array_join("recall_paths", ",").alias("recall_paths"))


def _in(values) -> str:
    return ", ".join(map(S.lit, values))


_FEATURES = S.skills_cte("(SELECT id, title || chr(10) || description AS body FROM postings)", "id", "body") + f""",
features AS (
  SELECT c.job_id, c.recall_paths, c.text_score,
    CASE WHEN list_position({S.array(_PROFILE.target_families)}, p.title_family) > 0 THEN
      1 - (list_position({S.array(_PROFILE.target_families)}, p.title_family) - 1) / {len(_PROFILE.target_families)}.0 * 0.5
      ELSE 0.0 END AS family_score,
    (SELECT count(*) FROM matched m WHERE m.id = p.id AND m.skill IN ({_in(_PROFILE.skills)}))
      / {min(len(_PROFILE.skills), 12)}.0 AS skill_coverage,
    (SELECT count(*) FROM matched m WHERE m.id = p.id AND m.skill IN ({_in(_PROFILE.rare_skills)}))
      / {len(_PROFILE.rare_skills)}.0 AS rare_coverage,
    p.company_normalized IN ({_in(_PROFILE.target_companies)}) AS company_match
  FROM candidates c JOIN postings p ON p.id = c.job_id
), scored AS (
  SELECT *, 100 * least(1.0, 0.4 * family_score + 0.25 * skill_coverage + 0.2 * rare_coverage
    + CASE WHEN company_match THEN 0.1 ELSE 0.0 END + 0.05 * text_score) AS retrieval_score FROM features
)"""
_SCORED = S.with_(S.POSTINGS, S.SCORES, *_TEXT, _PATHS, _FEATURES)


@query("retrieval_scores", _SCORED + """
SELECT job_id, recall_paths, round(family_score, 6) AS family_score, round(skill_coverage, 6) AS skill_coverage,
  round(rare_coverage, 6) AS rare_coverage, company_match, round(retrieval_score, 6) AS retrieval_score FROM scored""")
def retrieval_scores(spark, sf):
    found = R.retrieve(B.postings(spark, sf), B.scores(spark, sf), _PROFILE)
    return found.select(
        "job_id", F.array_join("recall_paths", ",").alias("recall_paths"),
        *[F.round(c, 6).alias(c) for c in ("family_score", "skill_coverage", "rare_coverage")],
        "company_match", F.round("retrieval_score", 6).alias("retrieval_score"))


@query("topk_candidates", _SCORED + """
SELECT job_id, round(retrieval_score, 6) AS retrieval_score FROM scored
ORDER BY round(scored.retrieval_score, 9) DESC, job_id LIMIT 25""")
def topk_candidates(spark, sf):
    found = R.retrieve(B.postings(spark, sf), B.scores(spark, sf), _PROFILE)
    # equal sums may differ in the last bit between engines, so ties are settled on rounded scores
    ranked = found.withColumn("retrieval_score", F.round("retrieval_score", 9))
    return R.top_candidates(ranked, 25).select(
        "job_id", F.round("retrieval_score", 6).alias("retrieval_score"))


@query("merge_retrieval", _SCORED + """
SELECT s.job_id, s.profile_version, round(coalesce(c.retrieval_score, s.retrieval_score), 6) AS retrieval_score,
  coalesce(c.recall_paths, '') AS recall_paths
FROM scores s LEFT JOIN scored c ON c.job_id = s.job_id AND s.profile_version = 'p1'""")
def merge_retrieval(spark, sf):
    scores = B.scores(spark, sf)
    found = R.retrieve(B.postings(spark, sf), scores, _PROFILE)
    return R.merge_retrieval(scores, found, "rubric-v1", "p1").select(
        "job_id", "profile_version", F.round("retrieval_score", 6).alias("retrieval_score"),
        F.array_join("recall_paths", ",").alias("recall_paths"))
