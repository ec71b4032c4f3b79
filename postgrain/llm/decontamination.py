"""Benchmark decontamination by multi-pattern search over words, after Wu and Manber.

Every window of benchmark words is a pattern. The text is read in blocks of two words: a shift table
says how far the search may jump when a block ends at the current place, because no pattern has that
block nearer to its end. Where the shift is zero, the block is the suffix of some patterns; the
bucket of that suffix and of the pattern's first block holds the few candidates, which are then
compared word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postgrain.llm.shared import SLICE_BYTES, mapped, picked, position, slices, staged

#: Fixed: words of both tables, after A-Z are lowered (bytes.lower() lowers ASCII letters alone).
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Patterns:
    """Search tables for patterns of one length: tuples of words, each with the items it is from."""

    def __init__(self, length: int, owners: dict[tuple[bytes, ...], set[int]]):
        self.length, self.block, self.owners = length, min(2, length), owners
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern in owners:
            for end in range(self.block, length + 1):
                key = self._key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            both = self._key(pattern, length), self._key(pattern, self.block)
            self.buckets.setdefault(both, []).append(pattern)

    def _key(self, words, end):
        return (words[end - 2], words[end - 1]) if self.block == 2 else words[end - 1]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence."""
        shift, default, length, block = self.shift.get, self.default, self.length, self.block
        end, count = length, len(words)
        while end <= count:
            key = (words[end - 2], words[end - 1]) if block == 2 else words[end - 1]
            jump = shift(key, default)
            if jump:
                end += jump
                continue
            start = end - length
            for pattern in self.buckets.get((key, self._key(words, start + block)), ()):
                if tuple(words[start:end]) == pattern:
                    yield start, pattern
            end += 1


def compiled(items: list[tuple[int, str | None]], window: int) -> list[Patterns]:
    """Search tables for a block of items, one per pattern length."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(tuple(words[k:k + size]), set()).add(item)
    return [Patterns(size, owners) for size, owners in sorted(by_length.items())]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 2 << 20,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_words, n_hit, n_items, items, spans``.

    ``spans`` are the runs of hit words as [first, last + 1] pairs, ``items`` the sorted ids of items
    (item_id, text) with an occurring window. A window is ``window`` consecutive item words; an item
    of fewer words is one window. A word inside any occurrence counts as hit once.

    Items are stored in the shared folder in blocks of about ``block_bytes`` bytes of text (one item at least),
    and each task reads one block at a time from there: neither the driver nor a broadcast holds them. Every
    block goes over each batch of documents in the same stage, and no document moves. Null or wordless texts have no
    words, wordless items no windows. Items of one text all count; rows of one item_id are one item; a null
    item_id is no item but its words still count as hit. Repeated documents are all returned. Other columns
    are ignored; empty tables give no hits or no rows.
    """
    run = _searcher(_stored(benchmark, block_bytes), window, 1, _summary)
    return picked(docs, "doc_id", "text").mapInArrow(run, _SCHEMA)


def without_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 2 << 20,
) -> DataFrame:
    """The rows of ``docs``, with all columns whatever their names, in which ``decontaminate`` finds no hit: each row
    by its own text, whatever its doc_id, in the pass that searches it. Null texts stay, repeated rows go or stay
    together, an empty table stays empty."""
    run = _searcher(_stored(benchmark, block_bytes), window, position(docs, "text"), _unhit)
    return mapped(docs, run, StructType(docs.schema.fields))


_SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items array<long>, "
           "spans array<array<long>>, items_sha256 string")
_HELD = 4  # compiled blocks that a task keeps


def _stored(benchmark: DataFrame, block_bytes: int) -> list[str]:
    """Files of the items, a block each: a name per block is all that the driver knows of them."""
    items = picked(benchmark, "item_id", "text").where("text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes)
    if not blocks:
        return []
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    stored = staged(dealt.repartitionById(blocks, F.col("block")).select("item_id", "text"), "items")
    return sorted(stored.inputFiles())


def _compiled_file(path: str, window: int) -> list[Patterns]:
    filesystem, name = pafs.FileSystem.from_uri(path)
    with filesystem.open_input_file(name) as file:
        rows = pq.read_table(file, columns=["item_id", "text"])
    return compiled(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True)), window)


def _searcher(files: list[str], window: int, text: int, result):
    """``result(batch, words, items, spans)`` of every batch; ``text`` is the place of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Patterns]] = {}
        # blocks that are not kept are read again for each slice, so slices grow with them
        for batch in slices(batches, text, SLICE_BYTES * min(32, max(1, 4 * (len(files) - _HELD)))):
            split = [words_of(x) for x in batch.column(text).to_pylist()]
            owners: list[set] = [set() for _ in split]
            hits: list[list] = [[] for _ in split]
            for file in files:
                tables = held.get(file)
                if tables is None:
                    tables = _compiled_file(file, window)
                    if len(held) < _HELD:
                        held[file] = tables
                for table in tables:
                    for words, mine, spans in zip(split, owners, hits, strict=True):
                        for start, pattern in table.find(words):
                            spans.append((start, start + table.length))
                            mine |= table.owners[pattern]
            yield result(batch, split, owners, hits)

    return run


def _unhit(batch: pa.RecordBatch, words: list[list], owners: list[set], hits: list[list]) -> pa.RecordBatch:
    return batch.filter(pa.array([not x for x in hits], pa.bool_()))


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _summary(batch: pa.RecordBatch, words: list[list], owners: list[set], hits: list[list]) -> pa.RecordBatch:
    spans = [_merged(x) for x in hits]
    items = [sorted(o for o in x if o is not None) for x in owners]
    named = [",".join(sorted(map(str, x))) for x in items]
    return pa.RecordBatch.from_pydict({
        "doc_id": batch["doc_id"].cast(pa.int64()),
        "n_words": pa.array([len(x) for x in words], pa.int64()),
        "n_hit": pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
        "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items": pa.array(items, pa.list_(pa.int64())),
        "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
        "items_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in named], pa.string()),
    })
