"""Token ids in files of patched frame-of-reference blocks.

A shard file holds the ids of a range of documents, in ascending doc_id order, as one stream cut
into blocks of 256. A block stores its smallest id; what the ids exceed it by is packed at a width
that most of them (a percentile) fit, and the others are listed as exceptions with their places.

    file:  blocks | block starts (u64, one more than blocks) | document ids (i64) | null flags (u8)
           | token counts of the documents (u64) | footer
    block: smallest id (u32) | exceptions (u16) | width (u8) | 0 | packed values (32 bytes a bit)
           | places of exceptions (u8) | their values (u32)
    footer: tokens (u64) | blocks (u64) | documents (u64) | b"PFORIDS1"

All numbers are little-endian. The last block is filled up with its smallest id.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.llm.shared import in_order, new_folder, slices, staged
from postgrain.llm.tokens import encoder

BLOCK = 256
GROUP = 2048  # blocks that are packed or unpacked at once
_FOOTER = struct.Struct("<QQQ8s")
_MAGIC = b"PFORIDS1"
U = np.uint64


# --- blocks -------------------------------------------------------------------------------------


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 values below 2**width as rows of 4 * width 64-bit words."""
    lanes = np.ascontiguousarray(values.T).astype(U)
    out = np.zeros((4 * width, values.shape[0]), U)
    for k in range(BLOCK if width else 0):
        word, shift = divmod(k * width, 64)
        out[word] |= lanes[k] << U(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[k] >> U(64 - shift)
    return np.ascontiguousarray(out.T)


def unpacked(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, words.shape[0]), U)
    for k in range(BLOCK if width else 0):
        word, shift = divmod(k * width, 64)
        out[k] = lanes[word] >> U(shift)
        if shift + width > 64:
            out[k] |= lanes[word + 1] << U(64 - shift)
    return np.ascontiguousarray((out & U((1 << width) - 1)).T).astype(np.uint32)


def encoded_blocks(ids: np.ndarray, percentile: float) -> list[bytes]:
    """The blocks of ``ids`` (uint32); its length is a multiple of 256."""
    rows = ids.reshape(-1, BLOCK)
    low = rows.min(axis=1)
    over = rows - low[:, None]
    rank = min(BLOCK - 1, int(BLOCK * percentile))
    widths = np.ceil(np.log2(np.partition(over, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(int)
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        part = over[own]
        large = part >= U(1 << width)
        body = packed(np.where(large, 0, part), width).astype("<u8")
        counts = large.sum(axis=1)
        places = np.nonzero(large)[1].astype(np.uint8)
        values = part[large].astype("<u4")
        ends = np.cumsum(counts)
        for k, (n, a, b) in enumerate(zip(own.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True)):
            out[n] = (struct.pack("<IHBB", low[n], b - a, width, 0) + body[k].tobytes()
                      + places[a:b].tobytes() + values[a:b].tobytes())
    return out


def decoded_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks at ``starts`` (which ends with the end of the last one)."""
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:-1, None] + np.arange(8)]
    low = heads[:, :4].copy().view("<u4")[:, 0]
    counts, widths = heads[:, 4:6].copy().view("<u2")[:, 0], heads[:, 6].astype(int)
    out = np.zeros((len(low), BLOCK), np.uint32)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        body = raw[(starts[:-1][own] + 8)[:, None] + np.arange(32 * width)]
        out[own] = unpacked(body.view("<u8") if width else np.zeros((len(own), 0), U), width)
    for n in np.flatnonzero(counts).tolist():
        at, count = int(starts[n]) + 8 + 32 * int(widths[n]), int(counts[n])
        out[n, raw[at:at + count]] = np.frombuffer(data, "<u4", count, at + count)
    return (out + low[:, None]).reshape(-1)


# --- files --------------------------------------------------------------------------------------


class ShardWriter:
    """Writes one shard under a name of its own; only finished files are named to anyone."""

    def __init__(self, folder: str, shard: int, percentile: float):
        self.filesystem, base = pafs.FileSystem.from_uri(folder)
        self.filesystem.create_dir(base, recursive=True)
        self.name = f"shard-{shard:06d}-{uuid.uuid4().hex}.pfor"
        self.out = self.filesystem.open_output_stream(f"{base}/{self.name}")
        self.percentile, self.waiting, self.held = percentile, [], 0
        self.at, self.tokens, self.starts = 0, 0, [0]
        self.docs: list = []
        self.counts: list[int] = []

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= GROUP * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting).astype(np.uint32)
        for start in range(0, count, GROUP * BLOCK):
            blocks = encoded_blocks(ids[start:min(count, start + GROUP * BLOCK)], self.percentile)
            self.out.write(b"".join(blocks))
            for block in blocks:
                self.at += len(block)
                self.starts.append(self.at)
        self.waiting, self.held = [ids[count:]], len(ids) - count
        self.tokens += count

    def close(self) -> int:
        """Finish the file; the number of its tokens."""
        if self.held:
            self._flush(self.held // BLOCK * BLOCK)
            rest = self.held
            if rest:
                low = min(int(x.min()) for x in self.waiting if len(x))
                self.waiting.append(np.full(BLOCK - rest, low, np.uint32))
                self.held = BLOCK
                self._flush(BLOCK)
                self.tokens -= BLOCK - rest
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array([0 if d is None else d for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array(self.counts, "<u8").tobytes())
        self.out.write(_FOOTER.pack(self.tokens, len(self.starts) - 1, len(self.docs), _MAGIC))
        self.out.close()
        return self.tokens


class ShardReader:
    def __init__(self, folder: str, name: str):
        filesystem, base = pafs.FileSystem.from_uri(folder)
        self.file = filesystem.open_input_file(f"{base}/{name}")
        end = self.file.size() - _FOOTER.size
        self.tokens, blocks, docs, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, end))
        if magic != _MAGIC:
            raise ValueError(f"{name} is not a file of token blocks")
        index = self.file.read_at(8 * (blocks + 1) + 17 * docs, end - 8 * (blocks + 1) - 17 * docs)
        self.starts = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        at = 8 * (blocks + 1)
        ids, none = np.frombuffer(index, "<i8", docs, at), np.frombuffer(index, np.uint8, docs, at + 8 * docs)
        self.docs = [None if n else d for d, n in zip(ids.tolist(), none.tolist(), strict=True)]
        self.counts = np.frombuffer(index, "<u8", docs, at + 9 * docs).tolist()

    def ids(self, first: int, count: int) -> np.ndarray:
        """Tokens ``first`` to ``first + count`` of the shard, through the index of block starts."""
        if not count:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, (first + count - 1) // BLOCK + 1
        data = self.file.read_at(int(self.starts[b] - self.starts[a]), int(self.starts[a]))
        return decoded_blocks(data, self.starts[a:b + 1] - self.starts[a])[first - a * BLOCK:first - a * BLOCK + count]

    def documents(self, tokens: int = GROUP * BLOCK) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document, first token in the shard, ids), decoding about ``tokens`` at a time."""
        k = at = 0
        while k < len(self.docs):
            last, size = k, 0
            while last < len(self.docs) and (last == k or size + self.counts[last] <= tokens):
                size += self.counts[last]
                last += 1
            ids, start = self.ids(at, size), 0
            for doc, count in zip(self.docs[k:last], self.counts[k:last], strict=True):
                yield doc, at + start, ids[start:start + count]
                start += count
            k, at = last, at + size


# --- Spark --------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, percentile: float = 0.9) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards in ``folder``; (shard, name), a row per file.

    ``folder`` is a URI that all executors reach. Documents are dealt by ranges of doc_id, so that
    shards and the documents in them ascend. A task that is repeated writes a file of a new name;
    only the files named in the returned (stored) table count. Null text: the end id alone. Null
    doc_id: before all others. Rows of one doc_id: by their text. Other columns are ignored.
    """
    dealt, _ = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", [F.xxhash64("text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, drops_space=True).encode
        end, writer, shard = np.array([end_id], np.uint32), None, 0
        for batch in slices(batches):
            if writer is None:
                shard = batch["bucket"][0].as_py()
                writer = ShardWriter(folder, shard, percentile)
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"]), strict=True):
                writer.add(doc, np.append(ids, end))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [writer.name]})

    return staged(dealt.select("doc_id", "text", "bucket").mapInArrow(run, "shard int, name string"), "shards")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Every document of the shards: ``doc_id, start, n_tokens, ids`` (little-endian u32 bytes).

    ``start`` counts the tokens of all documents before it in all shards. The driver sees one row
    per file: its name and the token count of its footer.
    """
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [ShardReader(folder, x).tokens for x in batch["name"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["shard"], batch["name"], pa.array(tokens, pa.int64())], names=["shard", "name", "tokens"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch["name"].to_pylist(), batch["base"].to_pylist(), strict=True):
                rows, size = [], 0
                for doc, first, ids in ShardReader(folder, name).documents():
                    rows.append((doc, base + first, len(ids), ids.astype("<u4").tobytes()))
                    size += len(ids)
                    if size > GROUP * BLOCK:
                        yield _documents(rows)
                        rows, size = [], 0
                yield _documents(rows)

    found = sorted(files.mapInArrow(totals, "shard int, name string, tokens long").collect(), key=lambda r: r.shard)
    base, rows = 0, []
    for k, r in enumerate(found):
        rows.append((k, r.name, base))
        base += r.tokens
    named = spark.createDataFrame(rows, "k int, name string, base long").repartitionById(max(1, len(rows)), F.col("k"))
    return named.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int = 2, percentile: float = 0.9) -> DataFrame:
    """Write all documents to a new folder in the shared place and read them back."""
    folder = new_folder(docs.sparkSession, "token-blocks")
    files = write_tokens(docs, tokenizer, end_id, folder, percentile)
    return read_tokens(docs.sparkSession, folder, files)
