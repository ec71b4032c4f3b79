"""Packing by powers of two: every document is cut into pieces of binary length, each a sequence.

A document of n tokens gives n // limit pieces of ``limit`` tokens and one piece for every binary
digit of the rest, longest first. A piece fills a sequence of its own length, so no sequence crosses
documents and none is padded; batches are drawn from one length bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postgrain.llm.shared import shuffle_partitions, slices, staged
from postgrain.llm.tokens import encoder

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids", pa.binary())])


def piece_lengths(tokens: int, limit: int) -> list[int]:
    """Powers of two that sum to ``tokens``, none above ``limit`` (a power of two), falling."""
    rest = tokens % limit
    digits = [1 << k for k in range(limit.bit_length() - 2, -1, -1) if rest >> k & 1]
    return [limit] * (tokens // limit) + digits


def decompose(docs: DataFrame, tokenizer: str, end_id: int = 0, limit: int = 1024) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): ``doc_id, doc_tokens, start, length, ids``.

    A document is the ids of its whole text by the byte-level tokenizer file ``tokenizer``, without
    special tokens, and ``end_id``; ``ids`` are little-endian unsigned 32-bit integers. Null and
    empty texts have the end id alone. Repeated rows and null ids are documents like all others;
    other columns are ignored; an empty table has no pieces. Nothing is shuffled.
    """
    if limit & (limit - 1) or limit < 1:
        raise ValueError(f"the limit must be a power of two, not {limit}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, drops_space=False).encode
        for batch in slices(batches):
            columns: list[list] = [[], [], [], [], []]
            for doc, own in zip(batch["doc_id"].to_pylist(), encode(batch["text"]), strict=True):
                ids = np.append(own, np.uint32(end_id)).astype("<u4").tobytes()
                at, total = 0, len(ids) // 4
                for length in piece_lengths(total, limit):
                    for column, value in zip(columns, (doc, total, at, length, ids[4 * at:4 * (at + length)]), strict=True):
                        column.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, doc_tokens long, start long, length long, ids binary")


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; bucket after bucket, the longest first.

    Read a stored table here: the numbers come from two looks at it. A bucket may hold most pieces,
    so each is dealt over as many parts as the session has shuffle partitions, which are counted
    first and numbered on their own. Rows that are equal in doc_id and start may swap numbers.
    """
    parts = shuffle_partitions(pieces.sparkSession)
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)))
    counts = dealt.groupBy("length", "_part").agg(F.count("*").alias("_count"))
    before = Window.orderBy(F.desc("length"), "_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each length and part: a proven bound
    bases = F.broadcast(counts.select("length", "_part", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base")))
    place = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "start"))
    return dealt.withColumn("_place", place).join(bases, ["length", "_part"]).select(
        *pieces.columns, (F.col("_base") + F.col("_place") - 1).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, limit: int = 1024) -> DataFrame:
    """Pieces with their ids and sequences: ``decompose`` stored, then ``numbered``."""
    return numbered(staged(decompose(docs, tokenizer, end_id, limit), "pieces"))
