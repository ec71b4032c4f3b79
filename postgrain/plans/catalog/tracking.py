"""Shortlist and application tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from postgrain.functions.money_time import iso_text
from postgrain.operators import shortlist as H
from postgrain.operators import tracker as T
from postgrain.plans import bindings as B
from postgrain.plans import sqltext as S
from postgrain.plans.registry import query
from postgrain.rules.constants import DIMENSIONS

LISTED = """ranked AS (
  SELECT s.job_id, s.rubric_score, s.scored_at, s.retrieval_score, p.company, p.title, p.source, p.location, p.remote,
    p.title_family, p.seniority, p.salary_text, p.posted_at, p.url,
    count(*) OVER w - 1 AS also_posted_in,
    row_number() OVER (w ORDER BY s.rubric_score DESC, s.job_id) AS place
  FROM scores s JOIN postings p ON p.id = s.job_id
  WHERE s.profile_version = 'p1' AND s.hard_filter_pass AND s.rubric_score IS NOT NULL AND p.status = 'active'
  WINDOW w AS (PARTITION BY p.company_normalized, p.description_hash)
), entries AS (
  SELECT t.*, a.status AS application_status, a.applied_at, a.notes, a.updated_at AS status_updated_at
  FROM ranked t LEFT JOIN applications a ON a.job_id = t.job_id WHERE t.place = 1
), page AS (
  SELECT * FROM entries ORDER BY rubric_score DESC, job_id LIMIT 200
)"""
_BASE = S.with_(S.POSTINGS, S.SCORES, S.EVENTS, LISTED)


def _applications(spark, sf):
    return T.fold_events(B.status_events(spark, sf))


def _listed(spark, sf, include_dismissed=True):
    return H.shortlist(
        B.postings(spark, sf), B.scores(spark, sf), _applications(spark, sf), "rubric-v1", "p1",
        limit=200, include_dismissed=include_dismissed)


def _entries(spark, sf):
    return H.all_entries(
        B.postings(spark, sf), B.scores(spark, sf), _applications(spark, sf), "rubric-v1", "p1",
        include_dismissed=True)


_COLUMNS = ("job_id", "rubric_score", "company", "title", "also_posted_in", "application_status", "notes")


@query("shortlist", _BASE + f"SELECT {', '.join(_COLUMNS)} FROM page")
def shortlist(spark, sf):
    return _listed(spark, sf).select(*_COLUMNS)


@query("shortlist_visible", _BASE + f"""
SELECT {', '.join(_COLUMNS)} FROM page WHERE application_status IS DISTINCT FROM 'dismissed'""")
def shortlist_visible(spark, sf):
    return _listed(spark, sf, include_dismissed=False).select(*_COLUMNS)


@query("stage_counts", _BASE + f"""
SELECT {S.progress('application_status', 0)} AS stage, count(*) AS entries FROM entries GROUP BY 1""")
def stage_counts(spark, sf):
    return H.stage_counts(_entries(spark, sf))


@query("filtered_shortlist", _BASE + f"""
SELECT job_id, source, title FROM entries WHERE {S.progress('application_status', 0)} = 'waiting'
  AND (contains(lower(company), 'engineer') OR contains(lower(title), 'engineer'))""")
def filtered_shortlist(spark, sf):
    return H.filter_entries(_entries(spark, sf), stage="waiting", text=" Engineer ").select(
        "job_id", "source", "title")


@query("shortlist_sources", _BASE + "SELECT DISTINCT source FROM entries")
def shortlist_sources(spark, sf):
    return H.distinct_sources(_entries(spark, sf))


@query("export_rows", _BASE + f"""
SELECT CAST(CAST(rubric_score AS BIGINT) AS VARCHAR) AS score, company, title, source, coalesce(location, '') AS location,
  CASE WHEN remote THEN 'remote' ELSE 'onsite' END AS remote, {S.progress('application_status', 0)} AS stage,
  {S.progress('application_status', 1)} AS next_action, coalesce(application_status, '') AS status,
  coalesce({S.iso('applied_at')}, '') AS applied_at, coalesce({S.iso('status_updated_at')}, '') AS status_updated_at,
  coalesce(title_family, '') AS title_family, coalesce(seniority, '') AS seniority,
  coalesce(salary_text, '') AS salary, CAST(also_posted_in AS VARCHAR) AS also_posted_in,
  coalesce({S.iso('posted_at')}, '') AS posted_at, {S.iso('scored_at')} AS scored_at, url,
  CAST(job_id AS VARCHAR) AS job_id FROM entries""")
def export_rows(spark, sf):
    from postgrain.sources.tables import export_text
    return export_text(H.export_rows(_entries(spark, sf).orderBy(F.desc("rubric_score"), "job_id")))


def _csv_cell(column: str) -> str:
    number = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
    guarded = (f"CASE WHEN regexp_matches({column}, {S.lit('^[=+@' + chr(9) + chr(13) + '-]')}) "
               f"AND NOT regexp_matches(trim({column}), {S.lit(number)}) THEN chr(39) || {column} ELSE {column} END")
    return (f"CASE WHEN regexp_matches({guarded}, {S.lit('[' + chr(34) + ',' + chr(13) + chr(10) + ']')}) "
            f"THEN chr(34) || replace({guarded}, chr(34), chr(34) || chr(34)) || chr(34) ELSE {guarded} END")


@query("csv_lines", f"""
SELECT doc_id::VARCHAR || ',' || {_csv_cell("coalesce(source, '')")} || ',' || {_csv_cell("coalesce(text, '')")} AS line
FROM documents""")
def csv_lines(spark, sf):
    """Whole texts as cells: their line breaks, commas and quotes stay."""
    from postgrain.session import read_table
    from postgrain.sources import tables
    return tables.csv_lines(read_table(spark, sf, "documents").select("doc_id", "source", "text"))


@query("bronze_archive", """
SELECT run_id, source, count(*) AS items, sum(length(text))::BIGINT AS characters
FROM (SELECT unnest([1, 2]) AS run_id, source, doc_id, coalesce(text, '') AS text FROM documents) WHERE run_id = 1 OR doc_id % 2 = 0
GROUP BY ALL""")
def bronze_archive(spark, sf):
    """Two runs appended to the raw archive, read back by source."""
    from postgrain.session import new_shared_folder, read_table
    from postgrain.sources import tables
    items = read_table(spark, sf, "documents").select(
        "source", F.col("doc_id").cast("string").alias("source_native_id"), F.coalesce("text", F.lit("")).alias("payload"), "doc_id")
    folder = new_shared_folder(spark, "bronze")
    tables.append_bronze(items, folder, 1, F.current_timestamp())
    tables.append_bronze(items.where("doc_id % 2 = 0"), folder, 2, F.current_timestamp())
    return spark.read.parquet(folder).groupBy("run_id", "source").agg(
        F.count("*").alias("items"), F.sum(F.length("payload")).alias("characters"))


_LONG = " UNION ALL ".join(
    f"SELECT job_id, {n + 1} AS place, {S.lit(name)} AS dimension, {S.lit(label)} AS label, "
    f"CAST((doc_id + {n}) % 13 AS DOUBLE) AS score, 'e1,{name}' AS evidence, 'note {n}' AS note "
    "FROM scores WHERE rubric_score IS NOT NULL" for n, (name, label) in enumerate(DIMENSIONS))


@query("dimensions_long", S.with_(S.SCORES) + _LONG)
def dimensions_long(spark, sf):
    return H.dimension_rows(B.scores(spark, sf)).withColumn("evidence", F.array_join("evidence", ","))


_APPLICATION = f"""SELECT job_id, status, {S.iso('applied_at')} AS applied_at, notes,
  {S.iso('created_at')} AS created_at, {S.iso('updated_at')} AS updated_at"""


def _shown(applications):
    return applications.select(
        "job_id", "status", iso_text("applied_at").alias("applied_at"), "notes",
        iso_text("created_at").alias("created_at"), iso_text("updated_at").alias("updated_at"))


@query("application_state", S.with_(S.EVENTS) + f"{_APPLICATION} FROM applications")
def application_state(spark, sf):
    return _shown(T.list_applications(_applications(spark, sf)))


@query("application_notes", S.with_(S.EVENTS) + "SELECT job_id, status, notes FROM applications WHERE notes IS NOT NULL")
def application_notes(spark, sf):
    return _applications(spark, sf).where("notes IS NOT NULL").select("job_id", "status", "notes")


@query("applications_in_two_steps", S.with_(S.EVENTS) + f"{_APPLICATION} FROM applications")
def applications_in_two_steps(spark, sf):
    """Folding old events, then new ones onto the stored rows, gives what one fold gives."""
    events = B.status_events(spark, sf)
    early = F.col("at") < "1997-01-01"
    stored = T.fold_events(events.where(early))
    return _shown(T.merge_applications(stored, events.where(~early)))


@query("tailoring_moves", S.with_(S.EVENTS) + """
SELECT c_custkey AS job_id, 'tailored' AS value FROM customer LEFT JOIN applications a ON a.job_id = c_custkey
WHERE coalesce(a.status, 'shortlisted') = 'shortlisted'""")
def tailoring_moves(spark, sf):
    from postgrain.session import read_table
    jobs = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("job_id"), F.lit("2024-06-01").cast("timestamp").alias("at"),
        F.lit(1).alias("seq"))
    return T.tailoring_events(jobs, _applications(spark, sf)).select("job_id", "value")
