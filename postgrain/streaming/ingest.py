"""Landed responses as a stream: each micro-batch is one incremental run.

The file source remembers what it has read in its checkpoint, so a run picks up what landed since
the last one; ``availableNow`` makes it a scheduled batch. A batch id is stored with what the batch
writes, so a batch replayed after a failure overwrites its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postgrain.operators.lifecycle import first_seen_dedupe
from postgrain.schemas import RAW_ITEM, THREAD_POSTING
from postgrain.sources.feeds import (
    READERS, good, read_hn, read_linkedin, read_linkedin_cards, read_thread_comments, rejects,
)
from postgrain.sources.tables import LANDING

REJECT = "source string, source_native_id string, reason string"
# Feeds whose responses repeat postings across queries or categories.
REPEATING = ("weworkremotely", "usajobs", "adzuna")


# Sources whose items are put together from responses of several kinds, told apart by `category`.
COMPOSED = ("linkedin", "hn")


def flatten_landed(
    landed: DataFrame, seeds: DataFrame, stored: DataFrame | None = None,
    extractions: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of landed responses of any feed; board feeds get their company name.

    A response of a source without a reader here is a reject of its own: nothing landed is lost.
    For linkedin and hn see :func:`linkedin_landed` and :func:`hn_landed`, which take ``stored``
    descriptions and cached ``extractions``.
    Only readers of feeds that landed something are planned; their names are a handful of values.
    """
    if "category" not in landed.columns:
        landed = landed.withColumn("category", F.lit(None).cast("string"))
    readable = F.coalesce(F.col("source").isin(*READERS, *COMPOSED), F.lit(False))
    bad = landed.where(~readable).select(
        "source", F.lit(None).cast("string").alias("source_native_id"),
        F.lit("no reader for this source").alias("reason"))
    landed = landed.where(readable)
    present = {r.source for r in landed.select("source").distinct().collect()}
    companies = seeds.where("verified").select(
        "token", F.col("board").alias("source"), F.col("name").alias("company"))
    pages = landed.join(companies, ["source", "token"], "left")
    items, none_bad = _nothing(landed)
    bad = bad.unionByName(none_bad)
    for source, reader in READERS.items():
        if source not in present:
            continue
        flat = reader(pages.where(F.col("source") == source).drop("source"))
        if source in REPEATING:
            fine = first_seen_dedupe(
                flat.where("reject_reason IS NULL"), "query_no", "page", "position")
            items = items.unionByName(good(fine))
        else:
            items = items.unionByName(good(flat))
        bad = bad.unionByName(rejects(flat))
    for source, composed, known in (
        ("linkedin", linkedin_landed, stored), ("hn", hn_landed, extractions),
    ):
        if source in present:
            fine, unfit = composed(landed.where(F.col("source") == source), known)
            items, bad = items.unionByName(fine), bad.unionByName(unfit)
    return items, bad


def _is_kind(*kinds: str) -> Column:
    return F.coalesce(F.lower("category").isin(*kinds), F.lit(False))


def _one_per_token(responses: DataFrame, key: str) -> DataFrame:
    """(key, payload): of responses that landed more than once under a token, the first."""
    return responses.where("token IS NOT NULL").groupBy(F.col("token").alias(key)).agg(
        F.min(F.struct("query_no", "page", "payload")).alias("_r")).select(key, "_r.payload")


def _left_over(source: str, responses: DataFrame, used: DataFrame, key: str, what: str) -> DataFrame:
    """Rejects for responses whose token is not among the keys they belong to."""
    keys = used.select(F.col(key).alias("token")).distinct()
    return responses.join(keys, "token", "left_anti").select(
        F.lit(source).alias("source"), F.col("token").alias("source_native_id"),
        F.concat(F.lit(f"{source} {what[0]} "), F.coalesce("token", F.lit("(no id)")),
                 F.lit(f" has no {what[1]}")).alias("reason"))


def linkedin_landed(landed: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of search pages and of detail pages (category ``detail``, token: the id).

    Cards of all search pages, each posting once, meet the detail pages of the same call and the
    ``stored`` descriptions, which win. A card with neither is a reject, and so is a detail page
    without a card. A search page without cards is the end of a walk and no reject.
    """
    details = landed.where(_is_kind("detail"))
    cards = read_linkedin_cards(landed.where(~_is_kind("detail")))
    unique = first_seen_dedupe(cards, "query_no", "page", "position")
    flat = read_linkedin(unique, _one_per_token(details, "source_native_id"), stored)
    alone = _left_over("linkedin", details, unique, "source_native_id", ("detail", "card"))
    return good(flat), rejects(flat).unionByName(alone)


def hn_landed(landed: DataFrame, extractions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of threads (category ``thread``, token: the thread) and what was found in them.

    Postings come from landed extractions (category ``extraction``, token: the comment, payload: a
    JSON array of postings), else from the cache ``extractions`` (comment_id, postings). An empty
    array says that a comment holds no posting. A comment without an extraction, an extraction
    that is no array or has no comment, and a thread without comments are rejects. Searches
    (category ``search``) only choose threads; other categories are rejects.
    """
    threads, found = landed.where(_is_kind("thread")), landed.where(_is_kind("extraction"))
    comments = read_thread_comments(_one_per_token(threads, "thread_id"))
    postings = F.from_json("payload", f"array<{THREAD_POSTING}>")
    read = F.when(F.startswith(F.trim("payload"), F.lit("[")), postings)
    known = _one_per_token(found, "comment_id").select(
        "comment_id", F.struct(F.lit(0).alias("rank"), read.alias("postings")).alias("_e"))
    if extractions is not None:
        known = known.unionByName(extractions.select("comment_id", F.struct(
            F.lit(1).alias("rank"), F.col("postings").cast(f"array<{THREAD_POSTING}>").alias("postings")
        ).alias("_e")))
    known = known.where("_e.postings IS NOT NULL").groupBy("comment_id").agg(
        F.min("_e").alias("_e")).select("comment_id", "_e.postings")
    flat = read_hn(comments, known)
    unread = comments.join(known, "comment_id", "left_anti").select(
        F.lit("hn").alias("source"), F.col("comment_id").alias("source_native_id"),
        F.concat(F.lit("hn comment "), "comment_id", F.lit(" has no extraction")).alias("reason"))
    other = landed.where(~_is_kind("thread", "extraction", "search")).select(
        "source", F.col("token").alias("source_native_id"),
        F.concat(F.lit("hn response of unknown category "), F.coalesce("category", F.lit("(none)"))).alias("reason"))
    bad = unread.unionByName(other).unionByName(
        _left_over("hn", threads, comments, "thread_id", ("thread", "comments"))).unionByName(
        _left_over("hn", found, comments, "comment_id", ("extraction", "comment")))
    return good(flat), bad


def _nothing(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Empty items and rejects."""
    session = landed.sparkSession
    return session.createDataFrame([], RAW_ITEM), session.createDataFrame([], REJECT)


def write_batch(
    batch: DataFrame, batch_id: int, seeds: DataFrame, bronze: str, reject_path: str,
    stored: DataFrame | None = None, extractions: DataFrame | None = None,
) -> None:
    """Store one micro-batch: its items by source and its rejects, each under the batch id."""
    items, bad = flatten_landed(batch, seeds, stored, extractions)
    items.withColumn("fetched_at", F.current_timestamp()).write.mode("overwrite").partitionBy(
        "source").parquet(f"{bronze}/run_id={batch_id}")
    bad.write.mode("overwrite").parquet(f"{reject_path}/run_id={batch_id}")


def ingest_stream(
    spark: SparkSession, landing: str, seeds: DataFrame, bronze: str, reject_path: str,
    checkpoint: str, after: Callable[[DataFrame, int], None] | None = None,
    stored: DataFrame | None = None, extractions: DataFrame | None = None,
) -> StreamingQuery:
    """Read everything landed since the last run, store it, then hand the items to ``after``.

    What belongs together (cards and details, threads and extractions) has to land for one run.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, seeds, bronze, reject_path, stored, extractions)
        if after is not None:
            after(batch.sparkSession.read.parquet(f"{bronze}/run_id={batch_id}"), batch_id)

    return (
        spark.readStream.schema(LANDING).json(landing)
        .writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
