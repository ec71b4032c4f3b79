"""Identity resolution, upsert, sweeps and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from postgrain.operators import identity as I
from postgrain.operators import lifecycle as L
from postgrain.operators import runs as R
from postgrain.plans import bindings as B
from postgrain.plans import sqltext as S
from postgrain.plans.registry import query
from postgrain.rules.constants import SOURCE_IDS
from postgrain.session import checkpointed, read_table

_TOKENS = ("list_distinct(list_filter(string_split(trim(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g')), ' '), "
           "lambda w: length(w) > 1))")
_NODES = f"""old AS (
  SELECT doc_id AS seq, source, source_native_id, canonical_url, company_normalized, title_family,
    location_key, variant_markers, title FROM postings WHERE k = 0
), moved AS (
  SELECT doc_id, 1000000000000 + doc_id AS seq,
    CASE doc_id % 4 WHEN 0 THEN source ELSE {S.pick(SOURCE_IDS, '(doc_id + 1) % 15')} END AS source,
    CASE doc_id % 4 WHEN 0 THEN source_native_id ELSE 'b' || doc_id END AS source_native_id,
    CASE WHEN doc_id % 4 < 2 THEN url ELSE 'https://other.example.org/' || doc_id END AS url,
    CASE doc_id % 4 WHEN 2 THEN title || ' Remote' WHEN 3 THEN 'Staff Principal ' || title ELSE title END AS title,
    location, location_key, company_normalized
  FROM postings WHERE k = 0
), fresh AS (
  SELECT doc_id, seq, source, source_native_id, {S.canonical_url('url')} AS canonical_url, company_normalized,
    {S.title_family('title')} AS title_family, location_key, {S.markers('title')} AS variant_markers, title
  FROM moved
), nodes AS (
  SELECT *, {_TOKENS.format(t='title')} AS words, company_normalized || '|' || coalesce(title_family, '') || '|'
    || location_key || '|' || {S.joined('variant_markers', '+')} AS block
  FROM (SELECT * FROM old UNION ALL BY NAME SELECT * EXCLUDE (doc_id) FROM fresh)
), matches AS (
  SELECT b.seq, b.block,
    (SELECT min(n.seq) FROM nodes n WHERE n.source = b.source AND n.source_native_id = b.source_native_id
      AND n.seq < b.seq) AS by_id,
    (SELECT min(n.seq) FROM nodes n WHERE n.canonical_url = b.canonical_url AND n.seq < b.seq) AS by_url,
    (SELECT min(n.seq) FROM nodes n WHERE n.block = b.block AND n.seq < b.seq
      AND len(list_intersect(n.words, b.words)) >=
        0.6 * (len(n.words) + len(b.words) - len(list_intersect(n.words, b.words)))) AS by_title
  FROM nodes b WHERE b.seq >= 1000000000000
), links AS (
  SELECT seq, block, CASE WHEN by_id IS NOT NULL THEN 'source-id' WHEN by_url IS NOT NULL THEN 'canonical-url'
      WHEN by_title IS NOT NULL THEN 'fingerprint' ELSE 'new' END AS stage,
    coalesce(by_id, by_url, by_title, seq) AS parent
  FROM matches
)"""
_CHAINS = """chains AS (
  SELECT seq, stage, parent AS root FROM links
  UNION ALL
  SELECT c.seq, c.stage, l.parent FROM chains c JOIN links l ON l.seq = c.root WHERE l.parent <> l.seq
), roots AS (SELECT seq, stage, min(root) AS root FROM chains GROUP BY seq, stage)
"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _identity(spark, sf):
    existing, batch = B.identity_tables(spark, sf)
    # both stand for stored tables
    return I.resolve_identity(checkpointed(existing), checkpointed(batch))


@query("identity_stages", _recursive(S.with_(S.POSTINGS, _NODES, _CHAINS.rstrip())) + """
SELECT r.seq, r.stage, CASE WHEN r.root < 1000000000000 THEN 'c' || r.root
  ELSE substr(sha256(l.block), 1, 32) END AS canonical_id
FROM roots r LEFT JOIN links l ON l.seq = r.root""")
def identity_stages(spark, sf):
    return _identity(spark, sf)


@query("canonical_clusters", _recursive(S.with_(S.POSTINGS, _NODES, _CHAINS.rstrip())) + """
SELECT r.stage, count(*) AS postings, count(DISTINCT CASE WHEN r.root < 1000000000000 THEN 'c' || r.root
  ELSE substr(sha256(l.block), 1, 32) END) AS identities
FROM roots r LEFT JOIN links l ON l.seq = r.root GROUP BY r.stage""")
def canonical_clusters(spark, sf):
    per_id = _identity(spark, sf).groupBy("stage", "canonical_id").agg(F.count("*").alias("n"))
    return per_id.groupBy("stage").agg(
        F.sum("n").alias("postings"), F.count("*").alias("identities"))


_SNAPSHOT = """snapshot AS (
  SELECT source, source_native_id, arg_max(value, seq) AS value, min(seen_at) AS first_seen_at,
    max(seen_at) AS last_seen_at,
    CASE WHEN max(run) < DATE '2024-01-09' THEN 'expired' ELSE 'active' END AS status
  FROM sightings WHERE run <= DATE '2024-01-10' GROUP BY ALL
), batch AS (
  SELECT source, source_native_id, arg_max(value, seq) AS value, arg_min(seen_at, seq) AS first_at,
    arg_max(seen_at, seq) AS last_at
  FROM sightings WHERE run = DATE '2024-01-11' AND source <> 'error' GROUP BY ALL
)"""


def _snapshot(spark, sf):
    seen = B.sightings(spark, sf)
    stored = seen.where("run <= '2024-01-10'").groupBy("source", "source_native_id").agg(
        F.max_by("value", "seq").alias("value"), F.min("seen_at").alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"), F.max("run").alias("_run"),
    ).withColumns({
        "missed_runs": F.when(F.col("_run") < "2024-01-09", 3).otherwise(0),
        "status": F.when(F.col("_run") < "2024-01-09", "expired").otherwise("active"),
    }).drop("_run")
    batch = seen.where("run = '2024-01-11' AND source <> 'error'").select(
        "source", "source_native_id", "value", "seq", "seen_at")
    return stored, batch


@query("upserted_state", S.with_(S.SIGHTINGS, _SNAPSHOT) + f"""
SELECT coalesce(s.source, b.source) AS source, coalesce(s.source_native_id, b.source_native_id) AS source_native_id,
  coalesce(b.value, s.value) AS value, {S.iso('coalesce(s.first_seen_at, b.first_at)')} AS first_seen_at,
  {S.iso('coalesce(b.last_at, s.last_seen_at)')} AS last_seen_at,
  CASE WHEN b.source IS NOT NULL THEN 0 WHEN s.status = 'expired' THEN 3 ELSE 0 END AS missed_runs,
  CASE WHEN b.source IS NOT NULL THEN 'active' ELSE s.status END AS status
FROM snapshot s FULL OUTER JOIN batch b ON s.source = b.source AND s.source_native_id = b.source_native_id""")
def upserted_state(spark, sf):
    from postgrain.functions.money_time import iso_text
    return L.upsert_postings(*_snapshot(spark, sf)).withColumns({
        "first_seen_at": iso_text("first_seen_at"), "last_seen_at": iso_text("last_seen_at")})


_DATED = """rows_ AS (SELECT id, source, posted_at, status, doc_id % 4 AS missed,
    TIMESTAMP '2024-02-01' + to_hours(CAST(doc_id % 48 AS INTEGER)) AS last_seen_at FROM postings)"""


def _dated(spark, sf):
    d = F.col("doc_id")
    return B.postings(spark, sf).select(
        "id", "source", "posted_at", "status", (d % 4).alias("missed_runs"),
        F.timestamp_seconds(F.lit(1706745600) + (d % 48) * 3600).alias("last_seen_at"))


def _sweep(spark, sf, covered):
    plan = spark.createDataFrame(
        [(s,) for s in SOURCE_IDS if s != "hn"], "source string"
    ).withColumns({"started_at": F.lit("2024-02-02").cast("timestamp"),
                   "covered_since": F.lit(covered).cast("timestamp")})
    return L.sweep_missing(_dated(spark, sf), plan).select("id", "missed_runs", "status", "expired_now")


def _sweep_sql(window: str) -> str:
    return S.with_(S.POSTINGS, _DATED) + f""", counted AS (SELECT *, source <> 'hn' AND status = 'active' AND
  last_seen_at < TIMESTAMP '2024-02-02' AND {window} AS hit FROM rows_)
SELECT id, missed + CAST(hit AS INTEGER) AS missed_runs,
  source <> 'hn' AND status = 'active' AND missed + CAST(hit AS INTEGER) >= 3 AS expired_now,
  CASE WHEN source <> 'hn' AND missed + CAST(hit AS INTEGER) >= 3 THEN 'expired' ELSE status END AS status
FROM counted"""


@query("sweep_full", _sweep_sql("true"))
def sweep_full(spark, sf):
    return _sweep(spark, sf, None)


@query("sweep_scoped", _sweep_sql("coalesce(posted_at >= TIMESTAMP '2024-01-15', false)"))
def sweep_scoped(spark, sf):
    return _sweep(spark, sf, "2024-01-15")


@query("lifecycle_history", S.with_(S.SIGHTINGS) + f"""
SELECT source, source_native_id, {S.iso('min(first_at)')} AS first_seen_at, {S.iso('max(last_at)')} AS last_seen_at,
  least(3, max(total) - max(run_no)) AS missed_runs,
  CAST(count(*) FILTER (WHERE run_no - before > 3) AS BIGINT) AS revivals,
  CASE WHEN max(total) - max(run_no) >= 3 THEN 'expired' ELSE 'active' END AS status
FROM daily GROUP BY source, source_native_id""")
def lifecycle_history(spark, sf):
    from postgrain.functions.money_time import iso_text
    return L.lifecycle_history(B.sightings(spark, sf)).withColumns({
        "first_seen_at": iso_text("first_seen_at"), "last_seen_at": iso_text("last_seen_at")})


@query("run_stats", S.with_(S.SIGHTINGS, S.RUN_STATS) + """
SELECT source, CAST(run AS VARCHAR) AS run, fetched, created, fetched - created AS updated, expired FROM stats""")
def run_stats(spark, sf):
    return L.run_stats(B.sightings(spark, sf)).withColumn("run", F.col("run").cast("string"))


@query("active_by_source", S.with_(S.POSTINGS, _DATED) + f"""
SELECT source, count(*) AS active, {S.iso('max(last_seen_at)')} AS last_seen_at
FROM rows_ WHERE status = 'active' GROUP BY source""")
def active_by_source(spark, sf):
    from postgrain.functions.money_time import iso_text
    return L.active_by_source(_dated(spark, sf)).withColumn("last_seen_at", iso_text("last_seen_at"))


@query("stored_descriptions", S.with_(S.POSTINGS) + """
SELECT source, source_native_id, sha256(description) AS description_hash FROM postings
WHERE description <> '' AND id % 3 = 0""")
def stored_descriptions(spark, sf):
    postings = B.postings(spark, sf)
    wanted = postings.where("id % 3 = 0").select("source", "source_native_id")
    return L.stored_descriptions(wanted, postings).select(
        "source", "source_native_id", F.sha2("description", 256).alias("description_hash"))


@query("posting_lookups", S.with_(S.POSTINGS) + """
SELECT 'url' AS lookup, id FROM postings WHERE canonical_url = 'https://jobs.example.com/8/1?a=1&b=2'
UNION ALL SELECT 'key', id FROM postings WHERE source = 'ashby' AND source_native_id = 'n30'
UNION ALL SELECT 'block', id FROM postings WHERE company_normalized = 'supplier 000000003'
  AND title_family IS NULL AND location_key = 'remote:any'
UNION ALL SELECT 'active', id FROM postings WHERE status = 'active'""")
def posting_lookups(spark, sf):
    p = B.postings(spark, sf)

    def tag(df, name):
        return df.select(F.lit(name).alias("lookup"), "id")

    return (
        tag(L.postings_by(p, canonical_url="https://jobs.example.com/8/1?a=1&b=2"), "url")
        .unionByName(tag(L.postings_by(p, source="ashby", source_native_id="n30"), "key"))
        .unionByName(tag(L.postings_by_key(p, "supplier 000000003", None, "remote:any"), "block"))
        .unionByName(tag(L.active_postings(p), "active"))
    )


@query("first_seen_dedupe", """
SELECT event_type AS source, user_id AS source_native_id, arg_min(event_id, {'a': value, 'b': event_id}) AS kept
FROM events GROUP BY ALL""")
def first_seen_dedupe(spark, sf):
    events = read_table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.col("user_id").alias("source_native_id"), "value", "event_id")
    return L.first_seen_dedupe(events, "value", "event_id").select(
        "source", "source_native_id", F.col("event_id").alias("kept"))


@query("covered_since", S.with_(S.RAW) + f"""
SELECT source, CASE WHEN source NOT IN ('himalayas', 'lever') THEN NULL ELSE {S.iso('min(posted_at)')} END
  AS covered_since FROM raw GROUP BY source""")
def covered_since(spark, sf):
    from postgrain.functions.money_time import iso_text
    items = B.raw_postings(spark, sf).select("source", "posted_at")
    walks = items.select("source").distinct().withColumn(
        "ended_on_feed", ~F.col("source").isin("himalayas", "lever"))
    return L.covered_since(items, walks).select("source", iso_text("covered_since").alias("covered_since"))


RUNLOG = """runlog AS (
  SELECT datediff('day', DATE '2023-12-31', run) AS id, min(seen_at) AS started_at,
    CASE WHEN datediff('day', DATE '2023-12-31', run) % 11 <> 5 THEN max(seen_at) END AS finished_at,
    CASE WHEN datediff('day', DATE '2023-12-31', run) % 11 = 5 THEN 'running'
      WHEN datediff('day', DATE '2023-12-31', run) % 7 = 3 THEN 'failed' ELSE 'completed' END AS status,
    datediff('day', DATE '2023-12-31', run) % 5 <> 4 AS is_scan,
    CASE WHEN datediff('day', DATE '2023-12-31', run) % 7 = 2
      THEN 'job 1 scoring failed: x | job 2 scoring failed: y' END AS error
  FROM sightings GROUP BY run
)"""


@query("stale_runs", S.with_(S.SIGHTINGS, RUNLOG) + f"""
SELECT id, CASE WHEN stale THEN 'failed' ELSE status END AS status,
  CASE WHEN stale THEN '2024-01-27T12:00:00.000Z' ELSE {S.iso('finished_at')} END AS finished_at,
  CASE WHEN stale THEN coalesce(error, 'never finished; marked failed at next startup') ELSE error END AS error
FROM (SELECT *, status = 'running' AND started_at < TIMESTAMP '2024-01-27 06:00:00' AS stale FROM runlog)""")
def stale_runs(spark, sf):
    from postgrain.functions.money_time import iso_text
    now = F.lit("2024-01-27 12:00:00").cast("timestamp")
    return R.fail_stale_runs(B.run_log(spark, sf), now).select(
        "id", "status", iso_text("finished_at").alias("finished_at"), "error")


@query("latest_run", S.with_(S.SIGHTINGS, RUNLOG) + """
SELECT id, status FROM runlog ORDER BY id DESC LIMIT 1""")
def latest_run(spark, sf):
    return R.latest_run(B.run_log(spark, sf)).select("id", "status")
