"""A counting filter over terms: which terms can be in enough postings at all.

Nearly every distinct term of a corpus is rare, so counting all of them shuffles mostly rows that a
threshold drops later. The first pass counts terms by hash, one array of counters per task; the arrays
are added up slice by slice, and the counters that reach the threshold become bits. A term whose bit is
unset is below the threshold for certain; a set bit proves nothing, so whoever uses the filter counts
exactly what is left. More buckets only let fewer rare terms through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.functions.terms import hashes_of, term_hash

SLICE = 1 << 16  # counters per shuffled row
BUCKETS = 1 << 24  # four bytes each in a task, one bit each in the plan that reads the filter
FULL = (1 << 32) - 1
# four to a power of two: the levels that counters are sorted into
_LEVELS = np.unique(np.ceil(2.0 ** (np.arange(4 * 32) / 4)).astype(np.int64))


def bucket_of(term: Column, buckets: int) -> Column:
    """The counter of a term."""
    return F.pmod(term_hash(term), F.lit(buckets)).cast("int")


def _count_batches(batches, hashed, buckets: int):
    """(slice, counters) of everything one task read; slices without a term are left out."""
    counters = np.zeros(buckets, np.uint32)
    for batch in batches:
        found = hashed(batch.column(0)).flatten().to_numpy(zero_copy_only=False)
        # in the order of the counters, of which each is touched once
        place = np.sort((found % buckets).astype(np.int32))
        edge = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
        counters[place[edge[:-1]]] += np.diff(edge).astype(np.uint32)
    for place, part in enumerate(counters.reshape(-1, SLICE)):
        if most := part.max():
            yield pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int32()),
                 pa.array([part.astype(np.min_scalar_type(most)).tobytes()], pa.binary())],
                names=["slice", "counters"])


def _add_batches(batches):
    """(slice, counters) added up; all rows of a slice are here, each as wide as its largest counter."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for place, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            more = np.frombuffer(part.as_buffer(), f"<u{part.as_buffer().size // SLICE}")
            totals[place] = more + totals.get(place, np.zeros(SLICE, np.uint64))
    for place, counts in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([place], pa.int32()),
             pa.array([np.minimum(counts, FULL).astype("<u4").tobytes()], pa.binary())],
            names=["slice", "counters"])


def _bit_batches(batches, least: int):
    """(slice, words) of bits that tell which counters reach ``least``."""
    for batch in batches:
        words = [np.packbits(np.frombuffer(part.as_buffer(), "<u4") >= least, bitorder="little").view("<i8")
                 for part in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["slice", "words"])


def _level_batches(batches):
    """(level, buckets, hits) of each slice."""
    for batch in batches:
        for part in batch.column(1):
            counts = np.frombuffer(part.as_buffer(), "<u4").astype(np.int64)
            counts = counts[counts > 0]
            place = np.searchsorted(_LEVELS, counts, "right") - 1
            used, back, number = np.unique(place, return_inverse=True, return_counts=True)
            hits = np.zeros(len(used), np.int64)
            np.add.at(hits, back, counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_LEVELS[used]), pa.array(number), pa.array(hits)], names=["level", "buckets", "hits"])


def _counters(rows: DataFrame, hashed, buckets: int) -> DataFrame:
    if buckets <= 0 or buckets % SLICE:
        raise ValueError(f"buckets: {buckets} is no positive multiple of {SLICE}")
    counted = rows.mapInArrow(
        lambda batches: _count_batches(batches, hashed, buckets), "slice int, counters binary")
    return counted.repartition("slice").mapInArrow(_add_batches, "slice int, counters binary")


def term_counters(texts: DataFrame, stopwords, buckets: int = BUCKETS) -> DataFrame:
    """(slice, counters): how often each bucket is hit by the distinct terms of the texts.

    ``texts`` has one column. ``buckets`` is a multiple of 65,536. A task holds four bytes per bucket,
    an adding task those of its slices.
    """
    words = tuple(stopwords)
    return _counters(texts, lambda column: hashes_of(column, words), buckets)


def level_of_share(counters: DataFrame, part: int, least_buckets: int) -> int:
    """The lowest level whose buckets have a ``part``-th of all hits at most, if so many buckets reach it.

    Else the highest level that ``least_buckets`` reach, 1 where there are fewer.
    """
    # at most 128 levels
    levels = sorted(
        counters.mapInArrow(_level_batches, "level long, buckets long, hits long")
        .groupBy("level").agg(F.sum("buckets").alias("buckets"), F.sum("hits").alias("hits")).collect(),
        reverse=True)
    total, chosen, buckets, hits = sum(r.hits for r in levels), None, 0, 0
    for r in levels:
        buckets, hits = buckets + r.buckets, hits + r.hits
        if chosen is not None and hits * part > total:
            break
        if buckets >= least_buckets:
            chosen = r.level
    return chosen or 1


def bits_of(counters: DataFrame, least: int, buckets: int = BUCKETS) -> DataFrame:
    """One row with ``bits`` (array of long): bit b is set when bucket b was hit ``least`` times."""
    threshold = min(max(least, 1), FULL)
    words = counters.mapInArrow(
        lambda batches: _bit_batches(batches, threshold), "slice int, words array<bigint>")
    every = counters.sparkSession.range(buckets // SLICE).select(F.col("id").cast("int").alias("slice"))
    unset = F.array_repeat(F.lit(0).cast("bigint"), SLICE // 64)
    filled = every.join(words, "slice", "left").select(
        F.struct("slice", F.coalesce("words", unset).alias("words")).alias("s"))
    return filled.agg(F.flatten(F.transform(
        F.array_sort(F.collect_list("s")), lambda s: s["words"])).alias("bits"))


def reaching_bits(terms: DataFrame, column: str, least: int, buckets: int = BUCKETS) -> DataFrame:
    """:func:`bits_of` distinct terms that are already arrays in ``column``, or null.

    Counters stop at 2^32 - 1, so a larger ``least`` counts as that. No rows give unset bits.
    """
    hashed = terms.select(F.transform(column, lambda t: term_hash(t)).alias("h"))
    return bits_of(_counters(hashed, lambda lists: lists, buckets), least, buckets)


def reaching_test(bits: DataFrame, buckets: int = BUCKETS):
    """:func:`may_reach` for arrays of hashes within a task; the bits (an eighth of ``buckets`` in bytes) go with it."""
    words = np.array(bits.head().bits, "<i8").view(np.uint8)

    def keep(hashes: np.ndarray) -> np.ndarray:
        place = hashes % buckets
        return (words[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

    return keep


def may_reach(term: Column | str, bits: DataFrame, buckets: int = BUCKETS) -> Column:
    """False for terms that are certainly below the threshold ``bits`` was made for."""
    place = bucket_of(F.col(term) if isinstance(term, str) else term, buckets)
    word = F.get(bits.scalar(), F.floor(place / F.lit(64)).cast("int"))
    return F.bit_get(word, place % F.lit(64)) == F.lit(1)
