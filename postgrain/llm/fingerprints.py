"""Content-defined chunks and weighted containment of their digest sets.

A gear hash runs over the code points of a text: every code point shifts it by one bit and adds a
fixed random word, so its low bits depend on the last few code points only. Chunks end where low
bits are zero. Chunking is normalised: before the usual length more bits must be zero, after it
fewer, which keeps lengths near the middle. An edit therefore changes the chunks around it and no
others. A fingerprint is the set of chunk digests, each with its length in code points.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postgrain.llm.shared import bucket_of, by_place, mapped, picked, position, shuffle_partitions, slices, split_points, texts
from postgrain.llm.wordhash import mixed, powers

SHORTEST, USUAL, LONGEST = 16, 32, 128
STRICT, LOOSE = np.uint32(2**6 - 1), np.uint32(2**4 - 1)
U = np.uint64
_GEAR = mixed(np.arange(0x110000, dtype=U), 41).astype(np.uint32)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _boundaries(points: np.ndarray) -> list[int]:
    """Ends of the chunks of a text."""
    size = len(points)
    if size <= SHORTEST:
        return [size] if size else []
    gear = _GEAR[points]
    for k in (1, 2, 4):  # the sum over the last 8 code points, each shifted by its age
        gear[k:] += gear[:-k] << np.uint32(k)
    loose = np.flatnonzero((gear & LOOSE) == 0) + 1
    strict = loose[(gear[loose - 1] & STRICT) == 0]
    at, out = 0, []
    soft, hard = loose.tolist() + [size + LONGEST], strict.tolist() + [size + LONGEST]
    s = h = 0
    while size - at > SHORTEST:
        low, middle = at + SHORTEST, at + USUAL
        while hard[h] < low:
            h += 1
        if hard[h] < middle:
            at = hard[h]
        else:
            while soft[s] < middle:
                s += 1
            at = min(soft[s], at + LONGEST, size)
        out.append(at)
    if at < size:
        out.append(size)
    return out


def chunk_set(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(digests, lengths) of the distinct chunks of a text, by digest; null counts as empty."""
    points = _code_points(text or "")
    ends = np.array(_boundaries(points), np.int64)
    if not len(ends):
        return np.zeros(0, U), np.zeros(0, np.int64)
    starts = np.append(0, ends[:-1])
    sizes = ends - starts
    at = np.arange(len(points)) - np.repeat(starts, sizes)
    sums = np.add.reduceat(mixed(points.astype(U), 43) * powers(LONGEST + 1)[at], starts)
    digests, first = np.unique(mixed(sums + sizes.astype(U) * U(0x9FB21C651E98DF25)), return_index=True)
    return digests, sizes[first]


def written(chunks: tuple[np.ndarray, np.ndarray]) -> str:
    """A chunk set as text: base64 of all digests, then of all lengths (a byte each)."""
    digests, sizes = chunks
    return base64.b64encode(digests.astype("<u8").tobytes() + sizes.astype(np.uint8).tobytes()).decode()


def containment(inner: tuple[np.ndarray, np.ndarray], outer: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the length of ``inner``'s chunks that ``outer`` has too; 1 for two empty sets."""
    if not len(inner[0]):
        return float(not len(outer[0]))
    both = np.isin(inner[0], outer[0], assume_unique=True)
    return float(inner[1][both].sum() / inner[1].sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every column of ``docs`` that is not named below, and per row of ``text``: ``n_chars``
    (code points), ``fingerprint`` and ``n_chunks``. Null text: as the empty text. Columns may have
    any name; repeated rows are all returned, an empty table gives an empty result."""
    new = StructType.fromDDL("n_chars long, fingerprint string, n_chunks int")
    places = [k for k, f in enumerate(docs.schema) if f.name.lower() not in new.names]
    at = places.index(position(docs, "text"))
    kept = by_place(docs).select(*(F.col(f"c{k}") for k in places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            text = texts(batch, at)
            sets = [chunk_set(x) for x in text]
            added = [pa.array([len(x) for x in text], pa.int64()), pa.array([written(x) for x in sets], pa.string()),
                     pa.array([len(x[0]) for x in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[str(k) for k in range(len(places) + 3)])

    return mapped(kept, run, StructType([*(docs.schema[k] for k in places), *new]))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text of a document is its text with the last ``n_chars // 3`` code points replaced by
    the first as many (or all) of the next document, by falling doc_id; after the last comes the
    first, and a lone document follows itself. ``near_edited`` and ``near_next`` are the shares of
    the document's chunks, by length, that the edited text and the next document have.

    Rows are dealt by ranges of doc_id and streamed in order. A range also gets the first row of the
    range after it, so texts move once. Null text: empty. Null doc_id: after all others. Rows with
    one doc_id: ordered by their text. Equal rows follow one another. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = picked(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = shuffle_partitions(docs.sparkSession)
    points = split_points(rows, "doc_id", buckets)
    count = len(points) + 1
    # falling ids: range 0 holds the largest
    placed = rows.withColumn("bucket", F.lit(count - 1) - bucket_of(F.col("doc_id"), points))
    firsts = {r.bucket: r.top for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    if not firsts:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    order = sorted(firsts)
    follower = {b: order[(k + 1) % len(order)] for k, b in enumerate(order)}  # range -> next range
    # the first row of a range is also the guest at the end of the range before it
    heads = [(firsts[follower[b]], follower[b], b) for b in order]
    heads = docs.sparkSession.createDataFrame(heads, "top long, bucket int, host int")
    guests = placed.join(F.broadcast(heads), (placed["bucket"] == heads["bucket"])
                         & placed["doc_id"].eqNullSafe(heads["top"])).select(
        "doc_id", "text", F.col("host").alias("bucket"))
    guests = guests.groupBy("bucket").agg(F.min(F.struct(F.sha2("text", 256).alias("digest"), "doc_id", "text")).alias("row"))
    guests = guests.select("row.doc_id", "row.text", "bucket", F.lit(True).alias("guest"))
    dealt = placed.withColumn("guest", F.lit(False)).unionByName(guests)
    dealt = dealt.repartitionById(count, F.col("bucket")).sortWithinPartitions(
        "guest", F.desc_nulls_last("doc_id"), F.sha2("text", 256))
    return dealt.mapInArrow(_compare, _SCHEMA)


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, the guest last: each is compared with the one that follows it."""
    waiting, out = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                row = doc, text, chunk_set(text)
                if waiting is not None:
                    out.append(_compared(*waiting, text, row[2]))
                waiting = row
            yield _rows(out)
            out = []


def _compared(doc, text, chunks, next_text, next_chunks):
    third = len(text) // 3
    edited = text[:len(text) - third] + next_text[:third]
    changed = chunk_set(edited)
    return (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(chunks),
            written(changed), containment(chunks, changed), containment(chunks, next_chunks))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
