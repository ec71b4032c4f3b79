"""Pipeline health."""

from __future__ import annotations

from pyspark.sql import functions as F

from postgrain.operators import health as H
from postgrain.plans import bindings as B
from postgrain.plans import sqltext as S
from postgrain.plans.catalog.lifecycle import RUNLOG
from postgrain.plans.registry import query

# Active postings stand in the feeds of the run log: one feed per event type plus one unscanned.
_JOBS = """jobs AS (
  SELECT id, status, company_normalized, description_hash,
    CASE doc_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'error' ELSE 'archive' END
      AS source,
    TIMESTAMP '2024-01-29' + to_hours(CASE WHEN doc_id % 5 = 1 THEN -48 ELSE 0 END) AS last_seen_at
  FROM postings
), active AS (
  SELECT source, count(*) AS n, max(last_seen_at) AS seen FROM jobs WHERE status = 'active' GROUP BY source
), scan AS (SELECT max(id) AS id FROM runlog WHERE status = 'completed' AND is_scan),
scan_stats AS (
  SELECT s.id, t.source, t.fetched, CASE WHEN t.source = 'error' THEN 2 ELSE 0 END AS errors
  FROM scan s JOIN stats t ON datediff('day', DATE '2023-12-31', t.run) = s.id
), problems AS (
  SELECT x.id, x.source, CASE WHEN x.errors > 0 THEN x.source || ' errored (' || x.errors || ')'
    WHEN x.fetched = 0 THEN x.source || ' fetched 0' WHEN a.n IS NULL THEN x.source || ' has no active postings'
    WHEN epoch(TIMESTAMP '2024-01-31 06:00:00' - a.seen) / 3600 > 48 THEN x.source || ' last seen ' ||
      printf('%.0f', epoch(TIMESTAMP '2024-01-31 06:00:00' - a.seen) / 3600) || 'h ago' END AS problem
  FROM scan_stats x LEFT JOIN active a ON a.source = x.source
)"""
_AGE = "epoch_us(TIMESTAMP '2024-01-31 06:00:00') - epoch_us(finished_at)"


def _age_row(place: int, label: str, where: str) -> str:
    hours = f"(({_AGE}) / 3600000000.0)"
    return (f"SELECT {place} AS place, CASE WHEN {hours} > 48 THEN 'fail' WHEN {hours} > 26 THEN 'warn' ELSE 'ok' END"
            f" AS level, '{label}' AS label, '#' || id || ' completed ' || printf('%.1f', {hours}) || 'h ago' AS detail "
            f"FROM (SELECT * FROM runlog WHERE status = 'completed' {where} ORDER BY id DESC LIMIT 1)")


@query("health_report", S.with_(S.POSTINGS, S.SCORES, S.SIGHTINGS, S.RUN_STATS, RUNLOG, _JOBS) + f"""
SELECT 1 AS place, 'ok' AS level, 'profile' AS label, 'version p1' AS detail
UNION ALL {_age_row(2, 'last run', 'AND finished_at IS NOT NULL')}
UNION ALL SELECT 3, 'warn', 'aborted runs', count(*) || ' stuck at ''running'' (' ||
  string_agg('#' || id, ', ' ORDER BY id) || ')' FROM runlog WHERE status = 'running'
UNION ALL {_age_row(4, 'last scan', 'AND is_scan')}
UNION ALL SELECT 5, CASE WHEN count(problem) > 0 THEN 'warn' ELSE 'ok' END, 'sources (scan #' || any_value(id) || ')',
  CASE WHEN count(problem) > 0 THEN string_agg(problem, '; ' ORDER BY source) ELSE count(*) || ' fetched, all fresh' END
  FROM problems
UNION ALL SELECT 6, 'ok', 'unscanned sources', 'active rows from feeds the last scan did not fetch: ' ||
  string_agg(source, ', ' ORDER BY source) FROM active WHERE source NOT IN (SELECT source FROM scan_stats)
  HAVING count(*) > 0
UNION ALL SELECT 7, CASE WHEN n > 250 THEN 'warn' ELSE 'ok' END, 'unscored backlog', CASE WHEN n > 250
  THEN n || ' passing jobs unscored — more than one scan''s budget (250)' ELSE n || ' passing jobs awaiting a rubric call' END
  FROM (SELECT count(*) AS n FROM scores JOIN jobs ON jobs.id = job_id WHERE hard_filter_pass
    AND rubric_score IS NULL AND status = 'active')
UNION ALL SELECT 8, 'warn', 'run #' || id || ' errors', '2 rubric calls failed' FROM
  (SELECT * FROM runlog WHERE status <> 'running' ORDER BY id DESC LIMIT 1) WHERE error IS NOT NULL
UNION ALL SELECT 9, CASE WHEN n = 0 THEN 'warn' ELSE 'ok' END, 'shortlist', n || ' scored entries at the current profile'
  FROM (SELECT count(DISTINCT company_normalized || '|' || jobs.description_hash) AS n FROM scores
    JOIN jobs ON jobs.id = job_id WHERE hard_filter_pass AND rubric_score IS NOT NULL AND profile_version = 'p1'
    AND status = 'active')""")
def health_report(spark, sf):
    d = F.col("doc_id")
    jobs = B.postings(spark, sf).select(
        "id", "status", "company_normalized", "description_hash",
        B.pick(("click", "view", "purchase", "error", "archive"), d % 5).alias("source"),
        F.timestamp_seconds(F.lit(1706486400) - F.when(d % 5 == 1, 48 * 3600).otherwise(0)).alias("last_seen_at"))
    return H.health_report(
        B.run_log(spark, sf), jobs, B.scores(spark, sf), "p1", F.lit("2024-01-31 06:00:00").cast("timestamp"))

