"""The registered queries of this folder over the given tables, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.llm import (
    decontamination,
    fingerprints,
    jaccard_join,
    language_id,
    length_buckets,
    license_sentences,
    merkle_manifest,
    page_difference,
    quality_fm,
    secret_ledger,
    token_blocks,
    warc_members,
    whitening,
)
from postgrain.llm.shared import short_batches, staged

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _remainder(modulus: int) -> F.Column:
    """Null for a null doc_id: such a row is neither learned from nor held out."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def _held_out(modulus: int, rest: int) -> F.Column:
    return F.coalesce(_remainder(modulus) == rest, F.lit(False))


@_query
def op1_chunk_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, folder, "documents"))


@_query
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


@_query
def op3_language_codes(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language_id.fit(docs.where(_remainder(5) != 0))
    return language_id.predict(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": _held_out(5, 0)})


@_query
def op4_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    documents = token_blocks.token_blocks(_table(spark, folder, "documents"), WORD_TOKENIZER)
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op5_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_ledger.secrets(_table(spark, folder, "documents").select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_ledger.BASE))
    return found.select(
        "doc_id", *(of_kind(k).alias(f"n_{k}") for k in secret_ledger.BASE),
        F.sha2(secret_ledger.joined_spans(base), 256).alias("base_sha256"),
        secret_ledger.joined_spans(F.col("spans")).alias("spans"))


@_query
def op6_binary_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = length_buckets.decompose(_table(spark, folder, "documents"), BYTE_TOKENIZER)
    digests = staged(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return length_buckets.numbered(digests).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@_query
def op7_warc_members(spark: SparkSession, folder: str) -> DataFrame:
    found = warc_members.round_trip(_table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, folder, "documents"))


@_query
def op9_quality_machine(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = quality_fm.fit(docs, labels.where(_remainder(3) != 1))
    return quality_fm.predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": _held_out(3, 1)})


@_query
def op10_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return license_sentences.licenses(_table(spark, folder, "documents"))


@_query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    without_breaks = F.when(_remainder(2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return merkle_manifest.manifest(_table(spark, folder, "documents"), F.coalesce(without_breaks, "text"))


@_query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


@_query
def op13_page_difference(spark: SparkSession, folder: str) -> DataFrame:
    return page_difference.main_texts(_table(spark, folder, "pages"))


# --- checking SQL -------------------------------------------------------------------------------

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op2_decontamination"] = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{_WORD}') AS w
  FROM documents),
b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
p AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, list_slice(w, k, k + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
o AS MATERIALIZED (
  SELECT r, first, p.size, item_id FROM (
    SELECT r, size, unnest(range(1, len(w) - size + 2)) AS first, w FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size) s
  JOIN p ON p.size = s.size AND p.win = list_slice(s.w, s.first, s.first + s.size - 1)),
h AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(first, first + size)) AS q FROM o) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
      FROM o GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)"""

# RE2 folds more than ASCII where (?i) is set, so letters are listed
_FOLDED = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_PATTERNS = {
    "assign": rf"""({_FOLDED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+", "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"}
_LEAST = {"assign": 12, "access": 18, "hex": 16, "pem": 1}


def _spans_sql(kind: str, rank: int) -> str:
    pattern = _PATTERNS[kind].replace("'", "''")
    secret = f"regexp_extract(m, '{pattern}', 2)" if kind == "assign" else "m"
    return f"""
  SELECT r, sum(gap) OVER w + sum(length(m)) OVER w - length(m) AS a, length(m) AS n, {rank} AS rank,
    '{kind}' AS kind, length({secret}) >= {_LEAST[kind]} AS fits
  FROM (SELECT r, unnest(ms) AS m, unnest(list_transform(list_slice(gaps, 1, len(ms)), lambda x: length(x))) AS gap,
      unnest(range(len(ms))) AS k
    FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gaps FROM d))
  WINDOW w AS (PARTITION BY r ORDER BY k)"""


_SPAN = "kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT"
_KINDS = "".join(f", count(*) FILTER (kind = '{k}') AS n_{k}" for k in secret_ledger.BASE)
ORACLE["op5_secret_ledger"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans_sql(k, n) for n, k in enumerate(_PATTERNS))}),
f AS (SELECT r{_KINDS}, string_agg({_SPAN}, ',' ORDER BY a, rank) FILTER (kind <> 'pem') AS base,
  string_agg({_SPAN}, ',' ORDER BY a, rank) AS spans FROM s WHERE fits GROUP BY r)
SELECT doc_id{"".join(f", coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secret_ledger.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (r)"""

ORACLE["op8_jaccard_join"] = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex({_LOWERED.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(list_slice(w, k, k + 4), ' ')))
    WHEN len(w) > 0 THEN ['#' || array_to_string(w, ' ')] ELSE [] END AS s FROM d),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM g),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT g.doc_id, len(s)::BIGINT AS n_shingles, c AS component_id
FROM g JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = g.doc_id"""


def _licenses_sql() -> str:
    """Tags are split by repeated replacement, sentences and rules are joined; every text is read, with no test for anchors."""
    ls = license_sentences
    rows = lambda pairs: ", ".join("('{}', '{}')".format(*p) for p in pairs)
    text = f"translate(translate(coalesce(text, ''), '{ls.UPPER}', '{ls.LOWER}'), '~|', '  ')"
    tag = r"(spdx-license-identifier:[ \t(]*[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?\+?)"
    for _ in range(7):  # of up to eight licences
        text = rf"regexp_replace({text}, '{tag}[ \t)]+(?:and|or|with)[ \t(]{{1,9}}', '\1|spdx-license-identifier:', 'g')"
    text = rf"regexp_replace({text}, 'spdx-license-identifier:[ \t(]*{ls.OPERAND}', '|spdx \1|', 'g')"
    for pattern, to in ls.STEPS:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern, to.replace("$", "\\").replace("'", "''"))
    plain = "rtrim(translate(part, '~|', '  '))"
    for s in (s for s in ls.SENTENCES.values() if "*" in s):
        plain = f"regexp_replace({plain}, '^{ls._pattern(s, ' ', '(?:.* )?')}$', '{ls._words(s)}')"
    return rf"""
WITH known(words, id) AS (VALUES {rows(ls.known_sentences().items())}),
rules(run, name) AS (VALUES {rows((ls.written(run), name) for name, run in ls.RULES)}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {text} AS t FROM documents),
s AS (SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS k
  FROM (SELECT r, regexp_extract_all(t, '(?:{ls.sentence_pattern()})(?:[~|]|\z)|[^~|]+') AS parts FROM d)),
p AS MATERIALIZED (SELECT r, k, {plain} AS plain FROM s WHERE NOT regexp_full_match(rtrim(part, '~|'), '{ls.ITEM}')),
i AS (SELECT r, k, coalesce(a.id, b.id, '-') AS id FROM p LEFT JOIN known a ON a.words = plain
  LEFT JOIN known b ON b.words = regexp_replace(plain, '^{ls.STATES}(.+)$', 'says \1')),
g AS MATERIALIZED (SELECT r, string_agg('#' || id || ' ', '' ORDER BY k) AS ids, count(*) FILTER (id <> '-') AS n FROM i GROUP BY r),
u AS (SELECT r, unnest(runs) AS run, generate_subscripts(runs, 1) AS k
  FROM (SELECT r, regexp_extract_all(ids, '{ls.rule_pattern()}') AS runs FROM g)),
l AS (SELECT r, count(*) AS n, string_agg(coalesce(name, regexp_extract(run, ':([^ ]+)', 1)), ',' ORDER BY k) AS names
  FROM u LEFT JOIN rules USING (run) GROUP BY r)
SELECT doc_id, coalesce(g.n, 0)::BIGINT AS n_sentences, coalesce(l.n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses
FROM d LEFT JOIN g USING (r) LEFT JOIN l USING (r)"""


ORACLE["op10_license_rules"] = _licenses_sql()

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE["op7_warc_members"] = f"""
WITH p AS MATERIALIZED (
  SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, octet_length(encode(t)) AS bytes, sha1(t) AS hex, min(page_id) OVER (PARTITION BY t) AS first FROM p),
z AS (SELECT *, list_transform(range(40), lambda k: instr('0123456789abcdef', substr(hex, (k + 1)::BIGINT, 1)) - 1) AS x FROM q)
SELECT page_id, bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('{_BASE32}', (1 + (
    list_sum(list_transform(range(5), lambda j: (((x[((5 * k + j) // 4 + 1)::BIGINT] >> (3 - (5 * k + j) % 4)::BIGINT) & 1) << (4 - j)::BIGINT)))))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM z"""

_DEPTH = 16  # of the unrolled SQL: 3**16 rows a source and as many sources


def _merkle_sql() -> str:
    """Levels as tables: ``l{k}`` has a source's nodes, ``t{k}`` those above the subroots, ``c{k}`` each row's way up."""
    field = "coalesce(octet_length(encode(({0})::VARCHAR)) || ':' || ({0})::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) "
           "ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)")
    out = [f"""d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, {leaf('text')} AS leaf,
  CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS other FROM documents),
l0 AS MATERIALIZED (SELECT r, coalesce('s' || source, '') AS g, row_number() OVER w - 1 AS pos, leaf AS h,
  count(*) OVER (PARTITION BY source) AS n FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
c0 AS MATERIALIZED (SELECT d.*, g, pos, n, '' AS proof, other AS fold FROM d JOIN l0 USING (r))"""]

    def level(now: str, above: str, way: str, onward: str) -> str:
        return f"""r_{now} AS MATERIALIZED (SELECT g, pos // 3 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM {now} GROUP BY 1, 2),
{above} AS MATERIALIZED (SELECT g, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (n + 2) // 3 AS n FROM r_{now}),
{onward} AS MATERIALIZED (SELECT {way}.* EXCLUDE (pos, n, proof, fold), {way}.pos // 3 AS pos, ({way}.n + 2) // 3 AS n,
  CASE WHEN {way}.n > 1 THEN proof || array_to_string(list_filter(hs, lambda x, i: i <> {way}.pos % 3 + 1), '') ELSE proof END AS proof,
  CASE WHEN {way}.n > 1 THEN sha256(array_to_string(list_transform(hs, lambda x, i: CASE WHEN i = {way}.pos % 3 + 1 THEN fold ELSE x END), '')) ELSE fold END AS fold
  FROM {way} JOIN r_{now} q ON q.g = {way}.g AND q.run = {way}.pos // 3)"""

    out += [level(f"l{k}", f"l{k + 1}", f"c{k}", f"c{k + 1}") for k in range(_DEPTH)]
    out.append(f"""t0 AS MATERIALIZED (SELECT 'all' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, h, count(*) OVER () AS n, g AS name FROM l{_DEPTH}),
u0 AS MATERIALIZED (SELECT c.r, c.doc_id, c.leaf, t0.h AS subroot, t0.g, t0.pos, t0.n, c.proof, c.fold FROM c{_DEPTH} c JOIN t0 ON t0.name = c.g)""")
    out += [level(f"t{k}", f"t{k + 1}", f"u{k}", f"u{k + 1}") for k in range(_DEPTH)]
    return f"""WITH {", ".join(out)}
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.h AS verified
FROM u{_DEPTH} u JOIN t{_DEPTH} t ON t.g = u.g"""


ORACLE["op11_merkle_manifest"] = _merkle_sql()

# the given pages mark their articles, so SQL can read the same text from the markup alone
ORACLE["op13_page_difference"] = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(
  replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&#39;', ''''), '&amp;?', '&', 'g')) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""
