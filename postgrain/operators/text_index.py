"""Full-text statistics and BM25 with phrase queries.

Texts are tokenised once, in the scan: a document leaves it as its length and the places where
query words stand. A phrase occurs where all its words agree on the position it would start at,
so phrase frequency is one aggregation over those places, not a chain of position joins.

Words are compared by their stems. The stem of a document word is an expression of the scan; only
words that begin like a query stem are stemmed, so no vocabulary is built.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.functions.fanout import explode_rows, posexplode_rows
from postgrain.functions.stemming import common_start, porter_stem, stem_column
from postgrain.functions.text import bind, index_tokens
from postgrain.rules import constants as C
from postgrain.session import checkpointed

FIELDS = ("title", "company", "description")
# More query words than this are joined as a table; fewer are literals of the scan.
INLINE_WORDS = 4_000
_HITS = "array<struct<phrase:int,offset:int,field:int,start:int>>"


def clean_phrases(terms: Sequence[str]) -> list[str]:
    """Query phrases: trimmed, blanks dropped."""
    return [t for t in (x.strip() for x in terms) if t]


def _tokens(field: str) -> Column:
    return index_tokens(F.coalesce(F.col(field), F.lit("")))


def term_index(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(doc_id, term, tf): how often each token occurs in a document, over all fields."""
    return (
        explode_rows(docs, F.flatten(F.array(*map(_tokens, fields))), "term", "doc_id")
        .groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    )


def term_statistics(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(term, df, cf): documents and occurrences per token."""
    return term_index(docs, fields).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf")
    )


def query_words(phrases: Sequence[str]) -> list[tuple[int, int, str]]:
    """(phrase number, offset, token), with tokens split the way documents are."""
    out = []
    for number, phrase in enumerate(phrases):
        folded = "".join(
            c for c in unicodedata.normalize("NFD", phrase.lower())
            if unicodedata.category(c) != "Mn"
        )
        out += [(number, at, word) for at, word in enumerate(re.findall(r"[^\W_]+", folded))]
    return out


def _begins_like(token: Column, stems: Sequence[str]) -> Column:
    """Whether a word can have one of the stems: sets of beginnings, by their length (up to three)."""
    sizes: dict[int, set[str]] = {}
    for stem in stems:
        start = common_start(stem)[:3]
        sizes.setdefault(len(start), set()).add(start)
    if 0 in sizes:
        return F.lit(True)
    out = F.lit(False)
    for size, starts in sorted(sizes.items()):
        out = out | F.substring(token, 1, size).isin(*sorted(starts))
    return out


def phrase_scan(
    docs: DataFrame, phrases: Sequence[str], fields: Sequence[str] = FIELDS, stemmed: bool = True
) -> DataFrame:
    """(doc_id, dl, hits) for every document: its length and the places of query words.

    One pass over the texts, no shuffle. Phrases are numbered by their place in ``phrases``. Words
    count as equal when their stems are, or with ``stemmed=False`` when they are.
    """
    words = [(p, o, porter_stem(w) if stemmed else w) for p, o, w in query_words(phrases)]
    names = [f"_t{n}" for n in range(len(fields))]
    tokenised = docs.select("doc_id", *[_tokens(f).alias(n) for f, n in zip(fields, names)])
    length = sum((F.size(n) for n in names[1:]), F.size(names[0])).cast("bigint")
    if not words:
        return tokenised.select("doc_id", length.alias("dl"), F.array().cast(_HITS).alias("hits"))
    if len(words) > INLINE_WORDS:
        return _joined_scan(tokenised, names, length, words, stemmed)
    slots: dict[str, list[tuple[int, int]]] = {}
    for number, offset, word in words:
        slots.setdefault(word, []).append((number, offset))
    lookup = F.create_map(*[
        x for form, uses in slots.items() for x in (
            F.lit(form),
            F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(o).alias("offset"))
                      for p, o in uses]),
        )
    ])

    def places(name: str, field: int) -> Column:
        def likely(t: Column) -> Column:
            return _begins_like(t, list(slots)) if stemmed else t.isin(*slots)

        def found(known: Column) -> Column:
            return F.filter(
                F.transform(F.col(name), lambda t, i: F.when(likely(t), F.struct(
                    (F.element_at(known, t) if stemmed else t).alias("token"), i.alias("pos")))),
                lambda p: p.isNotNull() & p["token"].isNotNull(),
            )

        def uses(known: Column) -> Column:
            return F.flatten(F.transform(found(known), lambda p: F.transform(
                F.element_at(lookup, p["token"]),
                lambda u: F.struct(
                    u["phrase"].alias("phrase"), u["offset"].alias("offset"),
                    F.lit(field).alias("field"), (p["pos"] - u["offset"]).alias("start"),
                ),
            )))

        if not stemmed:
            return uses(lookup)
        # every different word is stemmed once per text: a map of those with a wanted stem
        pairs = F.transform(
            F.array_distinct(F.filter(F.col(name), likely)),
            lambda t: F.struct(t.alias("word"), stem_column(t).alias("stem")))
        return bind(F.map_from_entries(F.filter(pairs, lambda p: p["stem"].isin(*slots))), uses)

    hits = F.concat(*[places(n, i) for i, n in enumerate(names)])
    return tokenised.select("doc_id", length.alias("dl"), hits.alias("hits"))


def _joined_scan(tokenised: DataFrame, names, length: Column, words, stemmed: bool) -> DataFrame:
    """The same for any number of query words: tokens are rows that meet a table of the words."""
    spark = tokenised.sparkSession
    table = spark.createDataFrame(words, "phrase int, offset int, word string")
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(name).alias("tokens")) for n, name in enumerate(names)])
    spread = explode_rows(tokenised, fields, "_f", "doc_id")
    tokens = posexplode_rows(spread, "_f.tokens", "pos", "token", "doc_id", F.col("_f.field").alias("field"))
    word = stem_column(F.col("token")) if stemmed else F.col("token")
    hits = tokens.withColumn("word", word).join(table, "word").groupBy("doc_id").agg(F.collect_list(F.struct(
        "phrase", "offset", "field", (F.col("pos") - F.col("offset")).alias("start"))).alias("hits"))
    lengths = tokenised.select("doc_id", length.alias("dl"))
    return lengths.join(hits, "doc_id", "left").withColumn(
        "hits", F.coalesce(F.col("hits").cast(_HITS), F.array().cast(_HITS)))


def phrase_frequencies(scan: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """(doc_id, dl, phrase, tf) from a scan: occurrences of each phrase, never across fields.

    Hits are spread by document once; both aggregations then find them in place.
    """
    lengths: dict[int, int] = {}
    for number, _, _ in query_words(phrases):
        lengths[number] = lengths.get(number, 0) + 1
    places = (
        scan.select("doc_id", "dl", F.inline("hits")).repartition("doc_id")
        .groupBy("doc_id", "dl", "phrase", "field", "start").agg(F.count("*").alias("n"))
    )
    if len(lengths) > INLINE_WORDS:
        sizes = scan.sparkSession.createDataFrame(list(lengths.items()), "phrase int, size int")
        whole = places.join(sizes, "phrase").where("n = size")
    else:
        size = F.element_at(
            F.create_map(*[F.lit(x) for pair in (lengths or {0: 1}).items() for x in pair]),
            F.col("phrase"),
        )
        whole = places.where(F.col("n") == size)
    return whole.groupBy("doc_id", "dl", "phrase").agg(F.count("*").alias("tf"))


def corpus_stats(scan: DataFrame) -> DataFrame:
    """One row: documents and tokens."""
    return scan.agg(F.count("*").alias("docs"), F.sum("dl").alias("tokens"))


def rank_scan(
    scan: DataFrame, phrases: Sequence[str], wanted: Sequence[int] | None = None
) -> DataFrame:
    """(doc_id, rank) of documents holding at least one of the wanted phrases; smaller is better.

    Corpus totals are one row, read as a scalar subquery.
    """
    tf = phrase_frequencies(scan, phrases)
    if wanted is not None:
        tf = tf.where(F.col("phrase").isin(*wanted) if wanted else F.lit(False))
    # a row per phrase: joined, so that their number is free
    counts = tf.groupBy("phrase").agg(F.count("*").alias("_df"))
    stats = corpus_stats(scan).select(F.struct("docs", "tokens").alias("s"))
    k1, b = C.BM25_K1, C.BM25_B
    n = F.col("_df")
    total, average = F.col("_s.docs"), F.col("_s.tokens") / F.col("_s.docs")
    idf = F.greatest(F.log((total - n + 0.5) / (n + 0.5)), F.lit(C.BM25_IDF_FLOOR))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * ((1 - b) + b * F.col("dl") / average))
    return (
        tf.join(counts, "phrase").withColumn("_s", stats.scalar())
        .groupBy("doc_id").agg((-F.sum(idf * weight)).alias("rank"))
    )


def bm25(
    docs: DataFrame, phrases: Sequence[str], fields: Sequence[str] = FIELDS, stemmed: bool = True
) -> DataFrame:
    """BM25 of an OR of phrases over all of ``docs``; filter the result, not the input."""
    cleaned = clean_phrases(phrases)
    return rank_scan(checkpointed(phrase_scan(docs, cleaned, fields, stemmed)), cleaned)
