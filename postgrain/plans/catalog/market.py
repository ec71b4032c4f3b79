"""Market statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from postgrain.operators import market as M
from postgrain.plans import bindings as B
from postgrain.plans import sqltext as S
from postgrain.plans.registry import query
from postgrain.rules.skills import prose_terms
from postgrain.rules.stopwords import STOPWORDS

_HAVE = ("agents", "docker", "golang", "llm", "python", "sql")  # the skill list of the first profile

COHORTS = """cohorts AS (
  SELECT 'market' AS cohort, id, company_normalized FROM postings
  WHERE status = 'active' AND title_family IS NOT NULL
  UNION ALL
  SELECT 'shortlist', id, company_normalized FROM postings
  WHERE status = 'active' AND id IN (SELECT job_id FROM scores WHERE hard_filter_pass)
)"""
DEMAND = """demand AS (
  SELECT cohort, skill, count(DISTINCT company_normalized) AS companies, count(*) AS postings,
    array_to_string(list_sort(list_distinct(list(company_normalized)))[1:3], ', ') AS example_companies
  FROM cohorts JOIN matched USING (id) GROUP BY cohort, skill
)"""
_BASE = S.with_(S.POSTINGS, S.SCORES, S.skills_cte("postings", "id", "description"), COHORTS, DEMAND)
_TOTALS = """, counts AS (SELECT cohort, company_normalized, count(*) AS n FROM cohorts GROUP BY ALL),
totals AS (SELECT cohort, CAST(sum(n) AS BIGINT) AS postings, count(*) AS companies,
  arg_min(company_normalized, {'a': -n, 'b': company_normalized}) AS top_company, max(n) AS top_postings
  FROM counts GROUP BY cohort)
"""


def demand_of(spark, sf):
    return M.skill_demand(M.cohort_skills(B.postings(spark, sf), B.scores(spark, sf)))


def counts_of(spark, sf):
    postings = B.postings(spark, sf).where("status = 'active'").select(
        "id", "company_normalized", F.col("title_family").isNotNull().alias("m"), "status")
    listed = M.shortlist_cohort(postings, B.scores(spark, sf))
    return M.company_counts(
        postings.where("m").select(F.lit("market").alias("cohort"), "company_normalized").unionByName(
            listed.select(F.lit("shortlist").alias("cohort"), "company_normalized")))


@query("skill_demand", _BASE + "SELECT * FROM demand")
def skill_demand(spark, sf):
    return demand_of(spark, sf).withColumn(
        "example_companies", F.array_join("example_companies", ", "))


@query("skill_gaps", _BASE + f"""
SELECT s.skill, s.companies, s.postings, s.example_companies, coalesce(m.companies, 0) AS market_companies
FROM demand s LEFT JOIN demand m ON m.cohort = 'market' AND m.skill = s.skill
WHERE s.cohort = 'shortlist' AND s.companies >= 2 AND s.skill NOT IN ({', '.join(map(S.lit, _HAVE))})""")
def skill_gaps(spark, sf):
    return M.skill_gaps(demand_of(spark, sf), B.PROFILES[0]).withColumn(
        "example_companies", F.array_join("example_companies", ", "))


@query("skills_you_have", _BASE + f"""
SELECT skill, coalesce(max(companies) FILTER (WHERE cohort = 'shortlist'), 0) AS shortlist_companies,
  coalesce(max(postings) FILTER (WHERE cohort = 'shortlist'), 0) AS shortlist_postings,
  coalesce(max(companies) FILTER (WHERE cohort = 'market'), 0) AS market_companies
FROM demand WHERE skill IN ({', '.join(map(S.lit, _HAVE))}) GROUP BY skill""")
def skills_you_have(spark, sf):
    return M.skills_you_have(demand_of(spark, sf), B.PROFILES[0])


@query("cohort_totals", S.with_(S.POSTINGS, S.SCORES, COHORTS) + _TOTALS + "SELECT * FROM totals")
def cohort_totals(spark, sf):
    return M.cohort_totals(counts_of(spark, sf))


@query("top_company", S.with_(S.POSTINGS, S.SCORES, COHORTS) + _TOTALS
       + "SELECT cohort, top_company, top_postings FROM totals WHERE cohort = 'market'")
def top_company(spark, sf):
    return M.cohort_totals(counts_of(spark, sf)).where("cohort = 'market'").select(
        "cohort", "top_company", "top_postings")


@query("dominance", S.with_(S.POSTINGS, S.SCORES, COHORTS) + _TOTALS + f"""
SELECT cohort, top_company, top_postings, postings, {S.half_up('100.0 * top_postings / postings')} AS percent
FROM totals ORDER BY CAST(top_postings AS DOUBLE) / postings DESC, cohort LIMIT 1""")
def dominance(spark, sf):
    return M.dominance(M.cohort_totals(counts_of(spark, sf)))


_LINES = ("- [ ] RAG — 3/9 shortlist companies, 4 postings (added 2024-01-01)", "* not an item",
          "- [x] Evals", "  - [ x ] Docker — done", "- [ ]   ")


@query("new_gaps", _BASE + """
, size AS (SELECT count(DISTINCT company_normalized) AS n FROM cohorts WHERE cohort = 'shortlist')
SELECT skill, '- [ ] ' || skill || ' — ' || companies || '/' || n || ' shortlist companies, ' || postings
  || ' postings (added 2024-05-01)' AS line
FROM demand, size WHERE cohort = 'shortlist' AND companies >= 2
  AND skill NOT IN ('rag', 'evals', """ + ", ".join(map(S.lit, _HAVE)) + ")")
def new_gaps(spark, sf):
    lines = spark.createDataFrame([(x,) for x in _LINES], "value string")
    total = M.cohort_totals(counts_of(spark, sf)).where("cohort = 'shortlist'").select("companies").scalar()
    gaps = M.skill_gaps(demand_of(spark, sf), B.PROFILES[0])
    return M.new_gap_lines(lines, gaps, "2024-05-01", total)


def terms_cte(rows: str) -> str:
    """Tokens of each row by position; neighbours found by a self-join."""
    stop = ", ".join(map(S.lit, STOPWORDS))
    return f"""tok AS (
  SELECT row_key, company_normalized, generate_subscripts(t, 1) AS pos, unnest(t) AS token
  FROM (SELECT row_key, company_normalized,
    list_transform(regexp_extract_all(lower(description), '[a-z0-9][a-z0-9+#.]*(?:-[a-z0-9+#.]+)*'),
      lambda x: rtrim(x, '.')) AS t FROM {rows})
), fit AS (
  SELECT * FROM tok WHERE length(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN ({stop})
), grams AS (
  SELECT row_key, company_normalized, token AS term FROM fit
  UNION
  SELECT a.row_key, a.company_normalized, a.token || ' ' || b.token FROM fit a
  JOIN fit b ON a.row_key = b.row_key AND b.pos = a.pos + 1
), terms AS (
  SELECT term, count(DISTINCT company_normalized) AS companies, count(*) AS postings FROM grams GROUP BY term
)"""


def _unknown() -> str:
    bounded = "|".join(
        "".join(c if c.isalnum() or c in " -" else "\\" + c for c in t) for t in prose_terms())
    return f"NOT regexp_matches(term, {S.lit('(^|[^a-z0-9])(' + bounded + ')([^a-z0-9]|$)')})"


_RANKED = f"""
SELECT * FROM terms WHERE postings >= 3 AND companies >= 3 AND {_unknown()}
ORDER BY companies DESC, postings DESC, term LIMIT 40"""


@query("discover_terms", S.with_(
    S.POSTINGS, "job_rows AS (SELECT id AS row_key, company_normalized, description FROM postings "
    "WHERE status = 'active' AND title_family IS NOT NULL)", terms_cte("job_rows")) + _RANKED)
def discover_terms(spark, sf):
    return M.discover_terms(M.market_cohort(B.postings(spark, sf)))


@query("discover_document_terms", S.with_(
    "doc_rows AS (SELECT doc_id AS row_key, source AS company_normalized, text AS description FROM documents)",
    terms_cte("doc_rows")) + _RANKED)
def discover_document_terms(spark, sf):
    return M.discover_terms(B.text_postings(spark, sf))


@query("candidate_terms", S.with_(
    "doc_rows AS (SELECT doc_id AS row_key, source AS company_normalized, text AS description FROM documents)",
    terms_cte("doc_rows")) + "SELECT * FROM terms")
def candidate_terms(spark, sf):
    return M.term_counts(B.text_postings(spark, sf))
