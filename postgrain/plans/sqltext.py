"""DuckDB spellings used to check the Spark queries: expressions and table bindings.

Logic here is written independently of the Spark expressions; only fixed rule values are shared.
"""

from __future__ import annotations

from postgrain.functions.patterns import SPACES
from postgrain.plans import bindings as B
from postgrain.rules import titles as R
from postgrain.rules.constants import (
    APPLICATION_PROGRESS, DIMENSIONS, RUBRIC_VERSION, SENIORITY_LEVELS, SOURCE_HOME, SOURCE_IDS,
    TRACKING_PARAMS,
)
from postgrain.rules.skills import prose_terms

_SPACE = (
    r"\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({array(values)})[CAST({index} AS BIGINT) + 1]"


def re2(pattern: str) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        if pattern[i:i + 2] == r"\s":
            out.append(_SPACE if in_class else f"[{_SPACE}]")
            i += 2
            continue
        if pattern[i] == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        in_class = {"[": True, "]": False}.get(pattern[i], in_class)
        out.append(pattern[i])
        i += 1
    return "".join(out)


def like(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(re2(pattern))})"


def sub(text: str, pattern: str, new: str) -> str:
    return f"regexp_replace({text}, {lit(re2(pattern))}, {lit(new)}, 'g')"


def trim(text: str) -> str:
    return f"trim({text}, {lit(SPACES)})"


def squash(text: str) -> str:
    return trim(sub(text, r"\s+", " "))


def joined(items: str, separator: str = ",") -> str:
    return f"coalesce(array_to_string({items}, {lit(separator)}), '')"


def entities(text: str) -> str:
    for name, plain in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "),
                        ("ndash", "-"), ("mdash", "-"), ("hellip", "..."), ("amp", "&")):
        text = f"replace({text}, '&{name};', {lit(plain)})"
    return text


def html_text(html: str) -> str:
    t = sub(html, r"(?i)<\s*br\s*/?\s*>", "\n")
    t = sub(t, r"(?i)<\s*li[^>]*>", "- ")
    t = sub(t, r"(?i)<\s*/\s*(p|div|li|ul|ol|h[1-6]|tr|section)\s*>", "\n")
    t = sub(t, "<[^>]*>", "")
    t = f"replace({entities(t)}, chr(13) || chr(10), chr(10))"
    t = sub(t, "[ \t]+", " ")
    t = (f"array_to_string(list_transform(string_split({t}, chr(10)), "
         f"lambda part: {trim('part')}), chr(10))")
    return trim(sub(t, "\n{3,}", "\n\n"))


def title_family(title: str) -> str:
    t = f"lower({title})"
    arms = "".join(
        f" WHEN {' OR '.join(like(t, p) for p in patterns)} THEN {lit(family)}"
        for family, patterns in R.FAMILY_PATTERNS
    )
    return (f"CASE WHEN {like(t, R.MANAGER_PATTERN)} AND NOT {like(t, R.ENGINEER_PATTERN)} "
            f"THEN NULL{arms} END")


def seniority(title: str, description: str) -> str:
    arms = "".join(f" WHEN {like(f'lower({title})', p)} THEN {lit(level)}"
                   for level, p in R.SENIORITY_PATTERNS)
    years = (f"list_min(list_filter(list_transform(regexp_extract_all(lower({description}), "
             f"{lit(re2(R.YEARS_PATTERN))}, 1), lambda y: CAST(y AS INTEGER)), "
             f"lambda y: y > 0 AND y < {R.YEARS_LIMIT}))")
    tail = "".join(f" WHEN {years} >= {n} THEN {lit(level)}" for n, level in R.YEARS_LEVELS)
    return f"CASE{arms} WHEN {years} IS NULL THEN NULL{tail} ELSE 'junior' END"


def rank(level: str) -> str:
    return f"nullif(list_position({array(SENIORITY_LEVELS)}, {level}), 0) - 1"


def markers(title: str) -> str:
    return (f"list_filter({array(sorted(R.VARIANT_MARKERS))}, "
            f"lambda m: regexp_matches(lower({title}), '\\b' || m || '\\b'))")


def company_key(name: str) -> str:
    t = sub(f"translate(lower({name}), ',.', '  ')", rf"\b({'|'.join(R.COMPANY_SUFFIXES)})\b", " ")
    return squash(sub(t, r"[^a-z0-9&\s-]", " "))


def location_key(location: str, remote: str) -> str:
    clean = squash(sub(f"lower(coalesce({location}, ''))", r"[^a-z0-9\s]", " "))
    scope = squash(sub(clean, r"\bremote\b", ""))
    us = trim(sub(sub(scope, r"\bunited states\b", "us"), r"\busa\b", "us"))
    return (f"CASE WHEN {remote} THEN CASE WHEN {scope} = '' THEN 'remote:any' "
            f"ELSE 'remote:' || {us} END ELSE {clean} END")


def remote(stated: str, location: str, description: str) -> str:
    return (f"coalesce({stated}, coalesce({like(location, '(?i)' + R.REMOTE_LOCATION_PATTERN)}, false)"
            f" OR {like(description, '(?i)' + R.REMOTE_DESCRIPTION_PATTERN)})")


def canonical_url(url: str) -> str:
    u = trim(url)
    ok = f"regexp_matches({u}, '^(?i)https?://[^/?#]')"
    host = f"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\\.', '')"
    path = f"regexp_extract({u}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
    tail = f"CASE WHEN length({path}) <= 1 THEN '/' ELSE regexp_replace({path}, '/+$', '') END"
    drop = ", ".join(lit(p) for p in TRACKING_PARAMS)
    kept = (
        f"list_sort(list_transform(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), "
        f"lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({drop})), "
        "lambda p: {'a': icu_sort_key(split_part(p, '=', 1), 'root'), "
        "'b': icu_sort_key(split_part(p, '=', 2), 'root'), "
        "'k': split_part(p, '=', 1), 'v': split_part(p, '=', 2)}))"
    )
    query = f"array_to_string(list_transform({kept}, lambda p: p.k || '=' || p.v), '&')"
    return (f"CASE WHEN {ok} THEN lower(regexp_extract({u}, '^([A-Za-z]+)', 1)) || '://' || {host} || "
            f"({tail}) || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END ELSE {u} END")


def safe_url(url: str, source: str) -> str:
    homes = " ".join(f"WHEN {lit(s)} THEN {lit(u)}" for s, u in SOURCE_HOME.items())
    return (f"CASE WHEN regexp_matches({trim(url)}, '^(?i)https?://[^/?#]') THEN {trim(url)} "
            f"ELSE CASE {source} {homes} END END")


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def progress(status: str, index: int) -> str:
    arms = " ".join(f"WHEN {status} = {lit(k)} THEN {lit(v[index])}"
                    for k, v in APPLICATION_PROGRESS.items() if k)
    return f"CASE WHEN {status} IS NULL THEN {lit(APPLICATION_PROGRESS[None][index])} {arms} END"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


# ---- table bindings -------------------------------------------------------------------------

RAW = f"""raw AS (
  SELECT d.doc_id * 10 + k AS id, d.doc_id, k,
    {pick(SOURCE_IDS, 'd.doc_id % 15')} AS source,
    'n' || (d.doc_id * 10 + k) AS source_native_id,
    'https://www.Jobs.example.com/' || d.doc_id || '/' || k ||
      CASE WHEN d.doc_id % 2 = 0 THEN '/?utm_source=feed&b=2&a=1#top' ELSE '' END AS url,
    s.s_name || {pick(B.COMPANY_SUFFIXES, '(d.doc_id // 7) % 4')} AS company,
    {pick(B.TITLES, 'd.doc_id % 24')} AS title,
    {pick(B.LOCATIONS, '(d.doc_id // 3 + 5 * k) % 24')} AS location,
    CASE d.doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS remote,
    d.text || ' ' || {pick(B.PHRASES, '(d.doc_id // 5) % 23')} AS description,
    CASE WHEN d.doc_id % 3 <> 0 THEN '$' || CAST(floor(s.s_acctbal) AS BIGINT) END AS salary_text,
    CASE WHEN d.doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 30 AS INTEGER)) END
      AS posted_at
  FROM documents d
  JOIN supplier s ON d.doc_id % (SELECT count(*) FROM supplier) = s.s_suppkey,
  LATERAL (SELECT unnest(range(0, d.doc_id % 3 + 1)) AS k)
)"""

POSTINGS = f"""{RAW},
clean AS (
  SELECT id, doc_id, k, source, source_native_id, {squash('title')} AS title,
    {squash('company')} AS company, nullif({squash('location')}, '') AS location, remote AS stated,
    {trim('description')} AS description, {safe_url('url', 'source')} AS url, salary_text, posted_at
  FROM raw
), half AS (
  SELECT *, {remote('stated', 'location', 'description')} AS remote,
    {company_key('company')} AS company_normalized, {title_family('title')} AS title_family,
    {seniority('title', 'description')} AS seniority, {markers('title')} AS variant_markers,
    sha256(description) AS description_hash, {canonical_url('url')} AS canonical_url,
    CASE WHEN doc_id % 17 = 3 THEN 'expired' ELSE 'active' END AS status
  FROM clean
), postings AS (SELECT *, {location_key('location', 'remote')} AS location_key FROM half)"""

_SCORED = "(d.doc_id % 5 <> 2 AND coalesce(l.toxic, 0) = 0)"
SCORES = f"""scores AS (
  SELECT d.doc_id * 10 + k AS job_id, d.doc_id,
    sha256(trim(d.text || ' ' || {pick(B.PHRASES, '(d.doc_id // 5) % 23')})) AS description_hash,
    {lit(RUBRIC_VERSION)} AS rubric_version,
    CASE WHEN d.doc_id % 7 = 6 THEN 'p2' ELSE 'p1' END AS profile_version,
    d.doc_id % 6 <> 1 AS hard_filter_pass,
    CASE WHEN d.doc_id % 6 = 1 THEN 'remote-only' ELSE '' END AS reasons,
    CAST((d.doc_id * 7 + k) % 101 AS DOUBLE) AS retrieval_score,
    CASE WHEN {_SCORED} THEN CAST((d.doc_id * 13) % 80 + coalesce(l.quality, 0) * 20 AS DOUBLE) END
      AS rubric_score,
    CASE WHEN {_SCORED} AND d.doc_id % 9 <> 0
      THEN {pick(('low', 'medium', 'high'), 'd.doc_id % 3')} END AS uncertainty,
    CASE WHEN {_SCORED} AND d.doc_id % 10 <> 0 THEN 'because ' || d.doc_id END AS rationale,
    CASE WHEN {_SCORED} THEN CASE WHEN (d.doc_id + k) % 8 = 0 THEN 'v1' ELSE 'v2' END END AS prompt_version,
    CASE WHEN {_SCORED} THEN CASE WHEN d.doc_id % 12 = 0 THEN 'm0' ELSE 'm1' END END AS model_id,
    TIMESTAMP '2024-02-01' + to_minutes(CAST(d.doc_id % 1000 AS INTEGER)) AS scored_at
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id,
  LATERAL (SELECT unnest(range(0, d.doc_id % 3 + 1)) AS k)
)"""

# Same numbers as the score binding gives each dimension.
DIMENSION_SCORES = tuple(name for name, _ in DIMENSIONS)

SIGHTINGS = """sightings AS (
  SELECT event_type AS source, CAST(user_id AS VARCHAR) AS source_native_id,
    CAST(ts AS DATE) AS run, ts AS seen_at, event_id AS seq, value FROM events
), runs AS (
  SELECT source, run, row_number() OVER (PARTITION BY source ORDER BY run) AS run_no,
    count(*) OVER (PARTITION BY source) AS total
  FROM (SELECT DISTINCT source, run FROM sightings)
), perday AS (
  SELECT s.source, s.source_native_id, s.run, r.run_no, r.total, count(*) AS n,
    min(seen_at) AS first_at, max(seen_at) AS last_at
  FROM sightings s JOIN runs r ON s.source = r.source AND s.run = r.run
  GROUP BY ALL
), daily AS (
  SELECT *, lag(run_no) OVER w AS before, lead(run_no) OVER w AS after FROM perday
  WINDOW w AS (PARTITION BY source, source_native_id ORDER BY run_no)
)"""

RUN_STATS = """stats AS (
  SELECT d.source, d.run, CAST(sum(n) AS BIGINT) AS fetched,
    CAST(count(*) FILTER (WHERE before IS NULL) AS BIGINT) AS created,
    CAST(coalesce((SELECT count(*) FROM daily g WHERE g.source = d.source
      AND g.run_no + 3 = d.run_no
      AND coalesce(g.after, g.total + 1) - g.run_no > 3), 0) AS BIGINT) AS expired
  FROM daily d GROUP BY d.source, d.run, d.run_no
)"""

_LEVEL = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"
EVENTS = f"""app_events AS (
  SELECT o_custkey AS job_id, o_orderkey AS seq, o_orderdate AS moment,
    CASE WHEN o_orderkey % 4 = 1 THEN 'note' ELSE 'status' END AS kind,
    CASE WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE 'note ' || o_orderkey END
      WHEN o_orderstatus = 'O' THEN
        {pick(('shortlisted', 'tailored', 'applied', 'response', 'interview'), _LEVEL + ' - 1')}
      WHEN o_orderstatus = 'F' THEN
        {pick(('applied', 'offer', 'rejected', 'dismissed', 'applied'), _LEVEL + ' - 1')}
      ELSE 'applied' END AS value
  FROM orders
), applications AS (
  SELECT job_id,
    coalesce((arg_max(value, {{'a': moment, 's': seq}}) FILTER (WHERE kind = 'status')), 'shortlisted') AS status,
    arg_min(moment, {{'a': moment, 's': seq}}) FILTER (WHERE kind = 'status' AND value = 'applied') AS applied_at,
    nullif(trim(arg_max(value, {{'a': moment, 's': seq}}) FILTER (WHERE kind = 'note')), '') AS notes,
    min(moment) AS created_at, max(moment) AS updated_at
  FROM app_events GROUP BY job_id
)"""


def skills_cte(rows: str, key: str, text: str, name: str = "matched") -> str:
    """``name(key, skill)``: distinct skills of each row, one regex per lexicon term."""
    values = ", ".join(
        f"({lit(term)}, {lit('(^|[^a-z0-9])' + ''.join(c if c.isalnum() or c in ' -' else chr(92) + c for c in term) + '([^a-z0-9]|$)')}, {lit(skill)})"
        for term, skill in prose_terms().items()
    )
    return f"""{name} AS (
  SELECT DISTINCT t.{key}, x.skill
  FROM (SELECT {key}, lower({text}) AS low FROM {rows}) t
  JOIN (VALUES {values}) x(term, pattern, skill)
    ON contains(t.low, x.term) AND regexp_matches(t.low, x.pattern)
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
