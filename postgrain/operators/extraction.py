"""Cached extraction from threads and documents, and merging what was found into a profile."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postgrain.functions.text import sha256, trim
from postgrain.operators.profiles import Profile
from postgrain.rules.constants import THREAD_BATCH
from postgrain.schemas import THREAD_POSTING
from postgrain.session import checkpointed


def thread_comments(comments: DataFrame, limit: int | None = None) -> DataFrame:
    """The non-blank top-level comments of each thread: all, or the first ``limit``."""
    spoken = comments.where(trim("text") != "")
    rank = F.row_number().over(W.partitionBy("thread_id").orderBy("position"))
    return spoken if limit is None else spoken.withColumn("place", rank).where(F.col("place") <= limit)


def pending_batches(
    comments: DataFrame, cache: DataFrame, prompt_version: str, size: int = THREAD_BATCH
) -> DataFrame:
    """Comments not cached for this prompt, numbered into batches per thread, in thread order.

    A cached empty result counts as cached. Positions are cut into ranges; the counts of a thread's
    ranges give where each begins, so a thread of any size is numbered by many tasks. Equal positions
    of a thread go by comment_id.
    """
    done = cache.where(F.col("prompt_version") == prompt_version).select("comment_id")
    pending = comments.join(done, "comment_id", "left_anti")
    parts = int(comments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    # the cuts place rows only: any would give the same numbers
    cuts = comments.select(F.percentile_approx("position", shares, 100 * parts)).first()[0] if shares else None
    cuts = sorted(set(cuts or []))
    spread = pending.withColumn("_range", F.size(F.filter(F.lit(cuts), lambda c: c < F.col("position"))) if cuts else F.lit(0))
    keys = ["thread_id", "_range"]
    before = W.partitionBy("thread_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = spread.groupBy(*keys).count()  # at most a row per thread and range
    begins = checkpointed(counts.select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("position", "comment_id"))
    numbered = spread.withColumn("_place", place).join(begins, keys)
    return numbered.withColumn("batch_no", F.floor((F.col("_before") + F.col("_place") - 1) / size)).drop(
        "_range", "_place", "_before")


def extract_batches(
    pending: DataFrame, extractor: Callable[[list[tuple[str, str]]], dict[str, list[dict]]],
    prompt_version: str, size: int = THREAD_BATCH,
) -> DataFrame:
    """New cache rows (comment_id, thread_id, prompt_version, postings, error).

    The extractor maps a batch of (comment_id, text) to postings per comment id. A comment it
    leaves out is cached as empty; a batch it fails on carries an error and must not be cached.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("position")
        pairs = [(str(i), t) for i, t in zip(batch["comment_id"], batch["text"])]
        out = pd.DataFrame({
            "comment_id": [i for i, _ in pairs], "thread_id": batch["thread_id"].astype(str).values,
            "prompt_version": prompt_version,
        })
        try:
            found = extractor(pairs)
            out["postings"] = [list(found.get(i, [])) for i, _ in pairs]
            out["error"] = None
        except Exception as problem:
            out["postings"] = [None] * len(pairs)
            out["error"] = str(problem)
        return out

    # a group is one batch of at most `size` comments
    return pending.select("thread_id", "comment_id", "text", "position", "batch_no").groupBy(
        "thread_id", "batch_no"
    ).applyInPandas(
        run,
        "comment_id string, thread_id string, prompt_version string, "
        f"postings array<{THREAD_POSTING}>, error string",
    )


def document_keys(documents: DataFrame, prompt_version: str, model_id: str) -> DataFrame:
    """Cache key of each document: its text, the prompt and the model."""
    return documents.withColumn(
        "cache_key", sha256(F.concat("text", F.lit(f"|{prompt_version}|{model_id}")))
    )


def pending_documents(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def pruned_cache(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache rows some document still uses."""
    return cache.join(keyed.select("cache_key"), "cache_key", "left_semi")


def skill_inventory(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct skills over the cached results: listed skills and skills that carry evidence."""
    hits = cache.join(keyed.select("cache_key"), "cache_key", "left_semi")
    every = F.concat(
        F.col("skills"), F.transform("evidence", lambda e: e["skill"])
    )
    return (
        hits.select(F.explode(every).alias("raw"))
        .select(F.lower(trim("raw")).alias("skill")).where("skill <> ''").distinct()
    )


def inventory_evidence(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """(skill, source, detail), the source being the document title."""
    joined = keyed.select("cache_key", "title").join(cache, "cache_key")
    return joined.select("title", F.inline("evidence")).select(
        F.lower(trim("skill")).alias("skill"), F.col("title").alias("source"), "detail"
    ).where("skill <> ''")


def omitted_documents(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return pending_documents(keyed, cache).select("id")


def local_inventory(local: DataFrame, remote_names: DataFrame) -> DataFrame:
    """Local rows whose name and remote name are both unknown to the other inventory."""
    names = remote_names.select(F.lower("name").alias("_name")).distinct()
    remote_name = F.lower(F.get(F.split(F.col("remote"), "/"), 1))
    return (
        local.join(names, F.lower(F.col("name")) == F.col("_name"), "left_anti")
        .join(names, remote_name == F.col("_name"), "left_anti")
    )


def inventory_composition(total: DataFrame, kept: DataFrame, owners: list[str]) -> DataFrame:
    """One row: kept, duplicates, and kept rows by who owns their remote."""
    owner = F.lower(F.substring_index("remote", "/", 1))
    return kept.agg(
        F.count("*").alias("kept"),
        F.count_if(F.col("remote").isNotNull() & owner.isin(*[o.lower() for o in owners])).alias("owned"),
        F.count_if(F.col("remote").isNull()).alias("no_remote"),
    ).withColumn("total", total.agg(F.count("*")).scalar()).select(
        "total", "kept", (F.col("total") - F.col("kept")).alias("duplicates"), "owned", "no_remote",
        (F.col("kept") - F.col("owned") - F.col("no_remote")).alias("foreign_owned"),
    )


def merge_profile_skills(profile: Profile, found: list[str]) -> Profile:
    """Profile with extra skills; its version follows the skill list only."""
    extra = {s.strip().lower() for s in found}
    skills = tuple(sorted(set(profile.skills) | {s for s in extra if s}))
    text = json.dumps(list(skills), ensure_ascii=False, separators=(",", ":"))
    version = hashlib.sha256(f"{profile.version}|{text}".encode()).hexdigest()[:12]
    return replace(profile, skills=skills, version=version)


def merged_profile_rows(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """The same over tables: (version, skills) and (version, skill) -> merged rows.

    A profile's skills end up in one row anyway, so they are gathered per profile.
    """
    extra = found.select("version", F.lower(trim("skill")).alias("s")).where("s <> ''")
    gathered = extra.groupBy("version").agg(F.collect_set("s").alias("extra"))
    joined = profiles.join(gathered, "version", "left").withColumn(
        "skills", F.array_sort(F.array_union(
            "skills", F.coalesce("extra", F.array().cast("array<string>"))))
    )
    new = F.substring(sha256(F.concat("version", F.lit("|"), F.to_json("skills"))), 1, 12)
    return joined.select("version", new.alias("new_version"), "skills")
