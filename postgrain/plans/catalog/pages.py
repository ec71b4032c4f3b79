"""Web-page mining over the pages table, with board links and page state appended per page."""

from __future__ import annotations

from pyspark.sql import functions as F

from postgrain.operators import pages as P
from postgrain.plans import bindings as B
from postgrain.plans import sqltext as S
from postgrain.plans.registry import query
from postgrain.rules.boards import BOARD_NOISE, BOARDS, POSTING_KEYS
from postgrain.session import read_table

_LINKS = (
    '<a href="https://boards.greenhouse.io/Acme{n}/jobs/1">x</a><a href="https://jobs.lever.co/beta-{n}">y</a>',
    '<iframe src="https://boards.greenhouse.io/embed/job_board/js?for=acme{n}"></iframe>',
    '<a href="https://jobs.ashbyhq.com/ash.{n}">a</a><a href="https://jobs.ashbyhq.com/ash.{n}/2">b</a>'
    '<a href="https://www.breezy.hr/">c</a>',
    '<a href="https://apply.workable.com/work-{n}/">w</a><a href="https://team-{n}.na.teamtailor.com/jobs">t</a>',
    '<a href="https://jobs.smartrecruiters.com/Big{n}/9">s</a><a href="https://nine{n}.wd5.myworkdayjobs.com/x">d</a>',
)
_MANY = 25
_STATES = (
    '<script id="__NEXT_DATA__" type="application/json">{"props":{"jobs":[{"title":"t{n}","location":"l"}]}}</script>',
    '<script type="application/json">[{"slug":"s{n}"}]</script>',
    '<script>window.__NUXT__ = {"a":"}","rows":[1,{"Title":{n},"team":2}]};track();</script>',
    '<script src="/static/app{n}.js"></script><script SRC=\'https://cdn.example.com/v.js\'></script>',
    # more roots, keys and levels than a glance needs
    "".join(f'<script id="s{n}" type="application/json">[{n}]</script>' for n in range(_MANY))
    + '<script>__DATA__ = 1; window.__DATA__ = {"a":{"b":{"c":{"d":{"e":{"f":{"g":[{'
    + ",".join(f'"k{n}":{n}' for n in range(_MANY)) + "}]}}}}}}};</script>",
)


def _template(values, index):
    return B.pick(values, index)


def mined_pages(spark, sf):
    n = F.col("page_id")
    tail = F.concat(_template(_LINKS, n % 5), _template(_STATES, n % len(_STATES)))
    return read_table(spark, sf, "pages").select(
        "page_id", "url", F.concat("html", F.replace(tail, F.lit("{n}"), (n % 100).cast("string"))).alias("html"))


_MINED = f"""mined AS (SELECT page_id, url, html || replace({S.pick(_LINKS, 'page_id % 5')} ||
  {S.pick(_STATES, f'page_id % {len(_STATES)}')}, '{{n}}', CAST(page_id % 100 AS VARCHAR)) AS html FROM pages)"""
_HITS = "hits AS (SELECT page_id, provider, token, count(*) AS occurrences FROM (" + " UNION ALL ".join(
    f"SELECT page_id, {S.lit(b.provider)} AS provider, unnest(regexp_extract_all(html, "
    f"{S.lit(('(?i)' if b.ignore_case else '') + p)}, 1)) AS token FROM mined"
    for b in BOARDS for p in b.patterns
) + f") WHERE lower(token) NOT IN ({', '.join(map(S.lit, BOARD_NOISE))}) GROUP BY ALL)"


@query("board_hits", S.with_(_MINED, _HITS) + "SELECT * FROM hits")
def board_hits(spark, sf):
    return P.detect_boards(mined_pages(spark, sf)).drop("place")


_SITE = "regexp_extract(url, '://([^/?#]+)', 1)"


def _site_hits(spark, sf):
    pages = mined_pages(spark, sf)
    site = pages.select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("site"))
    return P.merge_hits(P.detect_boards(pages).join(site, "page_id"))


@query("site_hits", S.with_(_MINED, _HITS) + f"""
SELECT {_SITE} AS site, provider, token, CAST(sum(occurrences) AS BIGINT) AS occurrences
FROM hits JOIN mined USING (page_id) GROUP BY ALL""")
def site_hits(spark, sf):
    return _site_hits(spark, sf)


@query("page_targets", S.with_(_MINED, _HITS) + f"""
, sites AS (SELECT DISTINCT {_SITE} AS site FROM mined)
SELECT DISTINCT {_SITE} AS site, token FROM hits JOIN mined USING (page_id)
UNION SELECT site, t FROM (SELECT site, unnest(['acmesearch', 'acme-search', 'acme',
  split_part(regexp_replace(site, '^www\\.', ''), '.', 1), regexp_replace(site, '^www\\.', '')]) AS t FROM sites)
WHERE length(t) >= 2""")
def page_targets(spark, sf):
    hits = _site_hits(spark, sf)
    targets = mined_pages(spark, sf).select(
        F.regexp_extract("url", "://([^/?#]+)", 1).alias("site")).distinct().select(
        "site", F.lit("Acme Search").alias("name"), F.col("site").alias("domain"))
    return P.page_targets(targets, hits)


_SCRIPTS = r"""scripts AS (
  SELECT page_id, url, generate_subscripts(tags, 1) - 1 AS position, unnest(tags) AS tag, unnest(bodies) AS text
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<script((?:[\s/][^>]*)?)>(.*?)</script', 1) AS tags,
    regexp_extract_all(html, '(?is)<script((?:[\s/][^>]*)?)>(.*?)</script', 2) AS bodies FROM mined)
)"""


@query("script_blocks", S.with_(_MINED, _SCRIPTS) + r"""
SELECT page_id, position, regexp_extract(tag, '(?i)\sid\s*=\s*"([^"]*)"', 1) AS id,
  regexp_extract(tag, '(?i)\stype\s*=\s*"([^"]*)"', 1) AS type, text FROM scripts""")
def script_blocks(spark, sf):
    return P.script_blocks(mined_pages(spark, sf))


@query("script_sources", S.with_(_MINED) + """
SELECT page_id, CASE WHEN page_id % 5 = 3 THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/static/app' ||
  (page_id % 100) || '.js,https://cdn.example.com/v.js' ELSE '' END AS sources,
  CASE WHEN page_id % 5 = 3 THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/static/app' ||
  (page_id % 100) || '.js' ELSE '' END AS own FROM mined""")
def script_sources(spark, sf):
    return mined_pages(spark, sf).select(
        "page_id", F.array_join(P.script_sources("html", "url"), ",").alias("sources"),
        F.array_join(P.bundle_sources("html", "url"), ",").alias("own"))


@query("embedded_json", S.with_(_MINED) + f"""
SELECT page_id, 1 AS place, ['__NEXT_DATA__', 'application/json', 'window.__NUXT__'][page_id % 5 + 1] AS source,
  ['object', 'list', 'object'][page_id % 5 + 1] AS kind, [1, 1, 2][page_id % 5 + 1] AS length,
  ['props', '', 'a,rows'][page_id % 5 + 1] AS keys, ['props.jobs', '', 'rows'][page_id % 5 + 1] AS list_path,
  ['title,location', 'slug', 'Title,team'][page_id % 5 + 1] AS item_keys,
  [2, 1, 2][page_id % 5 + 1] AS posting_score
FROM mined WHERE page_id % 5 < 3
UNION ALL SELECT page_id, n + 1, '#s' || n, 'list', 1, '', NULL, '', 0
FROM mined, range({_MANY}) r(n) WHERE page_id % 5 = 4
UNION ALL SELECT page_id, {_MANY} + 1, 'window.__DATA__', 'object', 1, 'a', 'a.b.c.d.e.f.g',
  (SELECT string_agg('k' || n, ',' ORDER BY n) FROM range({_MANY}) r(n)), 0
FROM mined WHERE page_id % 5 = 4""")
def embedded_json(spark, sf):
    return P.embedded_json(mined_pages(spark, sf)).withColumns({
        "keys": F.array_join("keys", ","), "item_keys": F.array_join("item_keys", ",")})


@query("posting_like", f"""
WITH k AS (SELECT page_id, list_distinct(list_transform(string_split(regexp_replace(lower(url), '[^a-z]+', ',', 'g')
  || ',title,job_id', ','), lambda x: x)) AS keys FROM pages)
SELECT page_id, len(list_intersect(keys, {S.array(POSTING_KEYS)})) AS score FROM k""")
def posting_like(spark, sf):
    keys = F.split(F.concat(F.regexp_replace("url", "[^A-Za-z]+", ","), F.lit(",Title,Job_ID")), ",")
    return read_table(spark, sf, "pages").select(
        "page_id", P.posting_like_score(keys).cast("bigint").alias("score"))


@query("postings_arrays", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE NULL END AS entries FROM pages""")
def postings_arrays(spark, sf):
    n = F.col("page_id")
    body = F.replace(B.pick((
        '[{"a":"{u}"},1]', '{"jobs":{"x":1},"results":["{u}"],"items":[1,2]}', '{"items":[1,2,"{u}"]}',
        '{"jobs":"{u}"}', 'not json {u}'), n % 5), F.lit("{u}"), F.col("url"))
    return read_table(spark, sf, "pages").select(
        "page_id", F.when(P.postings_array(body).isNotNull(), F.size(P.postings_array(body))).alias("entries"))
