"""Column functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postgrain.functions import labels as L
from postgrain.functions import money_time as M
from postgrain.functions import skills as K
from postgrain.functions import taxonomy as X
from postgrain.functions import text as T
from postgrain.functions import urls as U
from postgrain.plans import bindings as B
from postgrain.plans import sqltext as S
from postgrain.plans.registry import query
from postgrain.rules.constants import DIMENSIONS, SOURCE_IDS
from postgrain.session import read_table


@query("html_text", f"SELECT page_id, sha256({S.html_text('html')}) AS text_hash FROM pages")
def html_text(spark, sf):
    pages = read_table(spark, sf, "pages")
    return pages.select("page_id", T.sha256(T.html_to_text("html")).alias("text_hash"))


@query("decoded_entities", f"""
SELECT page_id, sha256({S.entities('html')}) AS once,
  sha256({S.entities(S.entities("replace(html, '&amp;', '&amp;amp;')"))}) AS twice FROM pages""")
def decoded_entities(spark, sf):
    again = F.replace(F.col("html"), F.lit("&amp;"), F.lit("&amp;amp;"))
    return read_table(spark, sf, "pages").select(
        "page_id", T.sha256(T.decode_entities("html")).alias("once"),
        T.sha256(T.decode_entities(T.decode_entities(again))).alias("twice"))


_VARIED_URL = (
    "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN ' ' || replace(url, '://', '://WWW.') || ' ' "
    "WHEN 2 THEN split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || "
    "'z=1&Ref=y&a=2&a=1&mc_eid=q' ELSE 'mailto:' || page_id END"
)


@query("canonical_urls", f"""
SELECT page_id, {S.canonical_url('u')} AS canonical_url, {S.safe_url('u', 'src')} AS safe_url,
  CASE WHEN regexp_matches({S.trim('u')}, '^https?://')
    THEN lower(regexp_extract({S.trim('u')}, '://([^/?#]+)', 1)) ELSE 'link' END AS host
FROM (SELECT page_id, {_VARIED_URL} AS u, {S.pick(SOURCE_IDS, 'page_id % 15')} AS src FROM pages)""")
def canonical_urls(spark, sf):
    p = F.col("page_id")
    glue = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    varied = (
        F.when(p % 4 == 0, F.col("url"))
        .when(p % 4 == 1, F.concat(
            F.lit(" "), F.replace(F.col("url"), F.lit("://"), F.lit("://WWW.")), F.lit(" ")))
        .when(p % 4 == 2, F.concat(
            F.substring_index("url", "#", 1), glue, F.lit("z=1&Ref=y&a=2&a=1&mc_eid=q")))
        .otherwise(F.concat(F.lit("mailto:"), p.cast("string")))
    )
    return read_table(spark, sf, "pages").select(
        "page_id", varied.alias("u"), B.pick(SOURCE_IDS, p % 15).alias("src")
    ).select("page_id", U.canonicalize_url("u").alias("canonical_url"),
             U.safe_url("u", "src").alias("safe_url"), U.host_of("u").alias("host"))


# Host labels and their published ASCII forms.
_INTERNATIONAL = {
    "Bücher": "xn--bcher-kva", "MÜNCHEN": "xn--mnchen-3ya", "faß": "xn--fa-hia",
    "пример": "xn--e1afmkfd", "παράδειγμα": "xn--hxajbheg2az3al", "例え": "xn--r8jz45g",
    "测试": "xn--0zwm56d", "plain": "plain",
}
_MIXED = "?b=1&A=2&a=2&B=0&ä=1&a=10&_x=1&Z=&utm_source=q&a-b=3"


@query("international_urls", f"""
SELECT page_id, 'https://' || host || '/' || page_id ||
  '?_x=1&a=10&a=2&A=2&%C3%A4=1&a-b=3&b=1&B=0&Z=' AS canonical_url, host
FROM (SELECT page_id, {S.pick(list(_INTERNATIONAL.values()), f'page_id % {len(_INTERNATIONAL)}')} || '.'
  || lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM pages)""")
def international_urls(spark, sf):
    p = F.col("page_id")
    label = B.pick(list(_INTERNATIONAL), p % len(_INTERNATIONAL))
    site = F.regexp_extract("url", "://([^/?#]+)", 1)
    made = F.concat(F.lit("https://"), label, F.lit("."), site, F.lit("/"), p.cast("string"), F.lit(_MIXED))
    return read_table(spark, sf, "pages").select("page_id", made.alias("u")).select(
        "page_id", U.canonicalize_url("u").alias("canonical_url"), U.host_of("u").alias("host"))


@query("squashed_text", f"""
SELECT doc_id, sha256({S.squash('text')}) AS squashed, sha256(text) AS content_hash,
  length(text) AS shown_chars
FROM documents""")
def squashed_text(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", T.sha256(T.squash("text")).alias("squashed"),
        T.sha256("text").alias("content_hash"),
        F.length("text").cast("bigint").alias("shown_chars"))


@query("title_family", S.with_(S.POSTINGS) + "SELECT id, title_family FROM postings")
def title_family(spark, sf):
    return B.postings(spark, sf).select("id", "title_family")


@query("seniority", S.with_(S.POSTINGS) + f"""
SELECT id, seniority, CAST({S.rank('seniority')} AS BIGINT) AS seniority_rank FROM postings""")
def seniority(spark, sf):
    return B.postings(spark, sf).select(
        "id", "seniority", X.seniority_rank("seniority").cast("bigint").alias("seniority_rank"))


@query("variant_markers", S.with_(S.POSTINGS) + f"""
SELECT id, {S.joined('variant_markers', '+')} AS markers FROM postings""")
def variant_markers(spark, sf):
    return B.postings(spark, sf).select("id", F.array_join("variant_markers", "+").alias("markers"))


@query("company_key", S.with_(S.POSTINGS) + "SELECT id, company_normalized FROM postings")
def company_key(spark, sf):
    return B.postings(spark, sf).select("id", "company_normalized")


@query("location_key", S.with_(S.POSTINGS) + "SELECT id, location_key, remote FROM postings")
def location_key(spark, sf):
    return B.postings(spark, sf).select("id", "location_key", "remote")


@query("fingerprint", S.with_(S.POSTINGS) + f"""
SELECT id, sha256(company_normalized || '|' || coalesce(title_family, '') || '|' || location_key
  || '|' || {S.joined('list_sort(variant_markers)', '+')}) AS fingerprint FROM postings""")
def fingerprint(spark, sf):
    return B.postings(spark, sf).select("id", X.fingerprint(
        F.col("company_normalized"), F.col("title_family"), F.col("location_key"),
        F.col("variant_markers")).alias("fingerprint"))


def _tokens_sql(title: str) -> str:
    return (f"list_distinct(list_filter(string_split(regexp_replace({S.sub(f'lower({title})', '[^a-z0-9 ]', ' ')}, "
            "' +', ' ', 'g'), ' '), lambda w: length(w) > 1))")


@query("title_similarity", f"""
WITH pairs AS (SELECT doc_id, {_tokens_sql(S.pick(B.TITLES, 'doc_id % 24'))} AS a,
  {_tokens_sql(S.pick(B.TITLES, '(doc_id // 24) % 24'))} AS b FROM documents)
SELECT doc_id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 9)
  AS similarity FROM pairs""")
def title_similarity(spark, sf):
    d = F.col("doc_id")
    return read_table(spark, sf, "documents").select("doc_id", F.round(X.title_similarity(
        B.pick(B.TITLES, d % 24), B.pick(B.TITLES, F.floor(d / 24) % 24)), 9).alias("similarity"))


@query("skill_matches", S.with_(S.POSTINGS, S.skills_cte("postings", "id", "description")) + """
SELECT p.id, coalesce(string_agg(m.skill, ',' ORDER BY m.skill), '') AS skills
FROM postings p LEFT JOIN matched m ON m.id = p.id GROUP BY p.id""")
def skill_matches(spark, sf):
    return B.postings(spark, sf).select(
        "id", F.array_join(K.match_skills("description"), ",").alias("skills"))


_LIST_ENTRIES = ("go", "Python", " SQL ", "go to market", "node", "k8s", "nothing", "Docker; AWS")
_LIST_SQL = ("go", "python", "sql", "go to market", "node", "k8s", "nothing", "docker; aws")


@query("skill_list_matches", f"""
WITH entries AS (SELECT doc_id, e FROM (SELECT doc_id, unnest([
  {S.pick(_LIST_SQL, 'doc_id % 8')}, {S.pick(_LIST_SQL, '(doc_id // 8) % 8')}]) AS e FROM documents)),
known(e, skill) AS (VALUES ('go', 'golang'), ('python', 'python'), ('sql', 'sql'), ('node', 'javascript'),
  ('k8s', 'kubernetes'), ('docker; aws', 'docker'), ('docker; aws', 'aws'))
SELECT d.doc_id, coalesce((SELECT string_agg(DISTINCT k.skill, ',' ORDER BY k.skill)
  FROM entries n JOIN known k ON k.e = n.e WHERE n.doc_id = d.doc_id), '') AS skills FROM documents d""")
def skill_list_matches(spark, sf):
    d = F.col("doc_id")
    entries = F.array(B.pick(_LIST_ENTRIES, d % 8), B.pick(_LIST_ENTRIES, F.floor(d / 8) % 8))
    return read_table(spark, sf, "documents").select(
        "doc_id", F.array_join(K.match_skill_list(entries), ",").alias("skills"))


def _usd_sql(lo: str, hi: str) -> str:
    a, b = (f"(CASE WHEN {x} > 0 THEN CAST(floor({x} + 0.5) AS BIGINT) END)" for x in (lo, hi))
    fa, fb = f"'$' || format('{{:,}}', {a})", f"'$' || format('{{:,}}', {b})"
    return (f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CASE WHEN {a} = {b} THEN {fa} "
            f"ELSE {fa} || '–' || {fb} END WHEN {a} IS NOT NULL THEN {fa} || '+' "
            f"WHEN {b} IS NOT NULL THEN 'up to ' || {fb} END")


_LO = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN -1.0 ELSE o_totalprice END"
_HI = ("CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_totalprice "
       "ELSE o_totalprice + 1000 END")


@query("salary_texts", f"""
WITH o AS (SELECT o_orderkey, {_LO} AS lo, {_HI} AS hi, CAST(floor(o_totalprice) AS BIGINT) AS w FROM orders)
SELECT o_orderkey, {_usd_sql('lo', 'hi')} AS usd,
  'EUR ' || w || '-' || (w + 5) || ' yearly' AS plain,
  format('{{:,}}', w) || '–' || format('{{:,}}', w + 5) || ' EUR/yearly' AS slashed,
  'EUR ' || format('{{:,}}', w) || ' - ' || format('{{:,}}', w + 5) || ' per-year' AS spaced,
  CASE WHEN o_orderkey % 2 = 0 THEN 'tier ' || w ELSE 'scraped' END AS first_text
FROM o""")
def salary_texts(spark, sf):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    low = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, -1.0).otherwise(price)
    high = F.when(k % 3 == 0, F.lit(None)).when(k % 7 == 0, price).otherwise(price + 1000)
    whole = F.floor(price)
    eur, year = F.lit("EUR"), F.lit("yearly")
    tier = F.when(k % 2 == 0, F.concat(F.lit(" tier "), whole.cast("string"))).otherwise("   ")
    return read_table(spark, sf, "orders").select(
        "o_orderkey", M.usd_range(low, high).alias("usd"),
        M.plain_salary(whole.cast("double"), (whole + 5).cast("double"), eur, year).alias("plain"),
        M.slashed_salary(whole, whole + 5, eur, year).alias("slashed"),
        M.spaced_salary(whole, whole + 5, eur, F.lit("per-year")).alias("spaced"),
        M.first_salary(tier, F.lit("scraped")).alias("first_text"))


@query("timestamps", f"""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN NULL WHEN 3 THEN {S.iso("o_orderdate + INTERVAL 5 HOUR")}
    ELSE {S.iso('o_orderdate')} END AS parsed,
  {S.iso('o_orderdate')} AS from_seconds, {S.iso('o_orderdate')} AS from_millis
FROM orders""")
def timestamps(spark, sf):
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    day = F.date_format(at, "yyyy-MM-dd")
    month = B.pick(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
                   F.month(at) - 1)
    written = (
        F.when(k % 6 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k % 6 == 1, F.concat(day, F.lit("T00:00:00.000Z")))
        .when(k % 6 == 2, day)
        .when(k % 6 == 3, F.concat(day, F.lit("T00:00:00-05:00")))
        .when(k % 6 == 4, F.concat(
            F.lit("Mon, "), F.date_format(at, "dd"), F.lit(" "), month, F.lit(" "),
            F.date_format(at, "yyyy"), F.lit(" 00:00:00 +0000")))
        .otherwise(F.lit("soon"))
    )
    return read_table(spark, sf, "orders").select(
        "o_orderkey", M.iso_text(M.timestamp_or_null(written)).alias("parsed"),
        M.iso_text(M.timestamp_from_seconds(F.unix_seconds(at))).alias("from_seconds"),
        M.iso_text(M.timestamp_from_millis(F.unix_millis(at))).alias("from_millis"))


_DAYS = "CAST(floor((epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(posted_at)) / 86400000000) AS BIGINT)"


@query("display_labels", S.with_(S.RAW, S.SCORES) + f"""
SELECT r.id, CASE WHEN posted_at IS NULL THEN 'date unknown' WHEN {_DAYS} <= 0 THEN 'today'
    WHEN {_DAYS} = 1 THEN '1 day ago' ELSE {_DAYS} || ' days ago' END AS age,
  greatest(0, {_DAYS}) * CASE WHEN posted_at IS NULL THEN NULL ELSE 1 END AS days_since,
  CASE WHEN rubric_score >= 75 THEN 'strong' WHEN rubric_score >= 50 THEN 'fair' ELSE 'weak' END AS tone,
  CASE WHEN rubric_score IS NULL THEN '—' ELSE CAST(CAST(floor(rubric_score + 0.5) AS BIGINT) AS VARCHAR) END
    AS score_label,
  coalesce(salary_text, 'no comp stated') AS salary_label
FROM raw r JOIN scores s ON s.job_id = r.id""")
def display_labels(spark, sf):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    raw = B.raw_postings(spark, sf).select("id", "posted_at", "salary_text")
    scored = B.scores(spark, sf).select(F.col("job_id").alias("id"), "rubric_score")
    return raw.join(scored, "id").select(
        "id", L.posted_age_label("posted_at", now).alias("age"),
        F.when(F.col("posted_at").isNotNull(), L.days_since("posted_at", now)).cast("bigint").alias("days_since"),
        L.score_tone("rubric_score").alias("tone"), L.score_label("rubric_score").alias("score_label"),
        L.salary_label("salary_text").alias("salary_label"))


@query("stage_progress", S.with_(S.EVENTS) + f"""
SELECT job_id, seq, {S.progress('value', 0)} AS stage, {S.progress('value', 1)} AS next_action
FROM app_events WHERE kind = 'status'""")
def stage_progress(spark, sf):
    return B.status_events(spark, sf).where("kind = 'status'").select(
        "job_id", "seq", L.application_stage("value").alias("stage"),
        L.next_action("value").alias("next_action"))


@query("token_candidates", """
WITH w AS (SELECT s_suppkey, string_split(trim(regexp_replace(lower(s_name || ' AI, Inc.'), '[^a-z0-9]+', ' ', 'g')), ' ')
    AS words, 'supplier' || s_suppkey || '.example.com' AS host FROM supplier),
p AS (SELECT *, list_filter(words, lambda x: x NOT IN ('ai', 'and', 'inc')) AS plain FROM w),
g AS (SELECT s_suppkey, [array_to_string(words, ''), array_to_string(words, '-'), array_to_string(plain, ''),
    array_to_string(plain, '-'), split_part(host, '.', 1), host, words[1]] AS guesses FROM p),
u AS (SELECT s_suppkey, unnest(guesses) AS token, generate_subscripts(guesses, 1) AS pos FROM g),
f AS (SELECT s_suppkey, token, min(pos) AS pos FROM u WHERE length(token) >= 2 GROUP BY ALL)
SELECT s_suppkey, string_agg(token, ',' ORDER BY pos) AS tokens FROM f GROUP BY s_suppkey""")
def token_candidates(spark, sf):
    return read_table(spark, sf, "supplier").select("s_suppkey", F.array_join(L.token_candidates(
        F.concat("s_name", F.lit(" AI, Inc.")),
        F.concat(F.lit("WWW.supplier"), F.col("s_suppkey").cast("string"), F.lit(".example.com"))), ",",
    ).alias("tokens"))


@query("clamped_rubric", S.with_(S.SCORES) + f"""
SELECT job_id, CAST(floor(least(100.0, greatest(0.0, rubric_score * 1.5 - 10.5)) + 0.5) AS DOUBLE) AS overall,
  {" || ',' || ".join(f"CAST(CAST(least(10, (doc_id + {n}) % 13) AS BIGINT) AS VARCHAR)" for n in range(len(DIMENSIONS)))}
    AS dimension_scores
FROM scores WHERE rubric_score IS NOT NULL""")
def clamped_rubric(spark, sf):
    kept = B.scores(spark, sf).where("rubric_score IS NOT NULL").withColumn(
        "d", L.clamp_dimensions("dimensions"))
    return kept.select(
        "job_id", L.clamp_overall(F.col("rubric_score") * 1.5 - 10.5).alias("overall"),
        F.concat_ws(",", *[F.col("d")[n]["score"].cast("bigint").cast("string") for n, _ in DIMENSIONS])
        .alias("dimension_scores"))


@query("formula_guard", """
WITH cells AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '=SUM(' || c_custkey || ')' WHEN 1 THEN '-' || c_custkey
    WHEN 2 THEN '@' || c_name WHEN 3 THEN '+' || c_name WHEN 4 THEN chr(9) || c_name ELSE c_name END AS cell FROM customer)
SELECT c_custkey, CASE WHEN substr(cell, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13))
  AND try_cast(cell AS DOUBLE) IS NULL THEN '''' || cell ELSE cell END AS cell FROM cells""")
def formula_guard(spark, sf):
    k, name = F.col("c_custkey"), F.col("c_name")
    cell = (
        F.when(k % 6 == 0, F.concat(F.lit("=SUM("), k.cast("string"), F.lit(")")))
        .when(k % 6 == 1, F.concat(F.lit("-"), k.cast("string")))
        .when(k % 6 == 2, F.concat(F.lit("@"), name)).when(k % 6 == 3, F.concat(F.lit("+"), name))
        .when(k % 6 == 4, F.concat(F.lit("\t"), name)).otherwise(name)
    )
    return read_table(spark, sf, "customer").select("c_custkey", L.formula_guard(cell).alias("cell"))
