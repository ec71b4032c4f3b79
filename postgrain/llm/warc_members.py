"""WARC archives: written as one gzip stream a file, normalised to one gzip member a record.

Some crawlers compress a whole archive as a single gzip stream, in which no record can be reached
without inflating all before it. The normaliser inflates such a file once, front to back, rewrites
every record as a gzip member of its own and writes a sidecar index of member offsets, so that
any record can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.llm.shared import new_folder, slices, staged

CHUNK = 1 << 18
GZIP = 31  # zlib's window code for a gzip wrapper
#: Fixed: the profile that marks a revisit of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # pages carry no time


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record. A revisit has the HTTP headers of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}"]
    head = "WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Inflated:
    """The bytes of a file of gzip members (one, usually), a bounded piece at a time."""

    def __init__(self, source):
        self.source, self.inflater, self.buffer, self.raw = source, zlib.decompressobj(GZIP), b"", b""

    def _more(self) -> bool:
        while True:
            if self.inflater.eof:
                self.raw, self.inflater = self.inflater.unused_data, zlib.decompressobj(GZIP)
            self.raw = self.raw or self.source.read(CHUNK)
            if not self.raw:
                return False
            found = self.inflater.decompress(self.raw, 4 * CHUNK)
            self.raw = self.inflater.unconsumed_tail
            if found:
                self.buffer += found
                return True

    def head(self) -> bytes | None:
        """Everything up to and with the next blank line; None at the end."""
        at = -1
        while (at := self.buffer.find(b"\r\n\r\n", max(0, at))) < 0:
            at = len(self.buffer) - 3
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a record")
                return None
        out, self.buffer = self.buffer[:at + 4], self.buffer[at + 4:]
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends within a record")
            out, self.buffer = self.buffer[:size], self.buffer[size:]
            size -= len(out)
            yield out


def split_members(source, out) -> Iterator[tuple[int, int, str, str]]:
    """Rewrite the records of ``source`` as members of ``out``: (offset, length, type, id) of each."""
    stream, offset = Inflated(source), 0
    while (head := stream.head()) is not None:
        named = headers(head)
        packer, length = zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
        for piece in chain([head], stream.pieces(int(named["content-length"]) + 4)):  # with the end mark
            packed = packer.compress(piece)
            out.write(packed)
            length += len(packed)
        packed = packer.flush()
        out.write(packed)
        length += len(packed)
        yield offset, length, named["warc-type"], named["warc-record-id"]
        offset += length


# --- Spark --------------------------------------------------------------------------------------


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, revisit, refers_to`` for every row of ``pages`` (page_id, url, html).

    Of pages with equal payloads of at least ``least_bytes`` bytes those with the smallest page_id
    are responses and the others revisit it; a null page_id is larger than all others. Rows that
    repeat the smallest page_id are all responses. Null html is an empty payload. One payload may
    hold a third of all pages: payloads are grouped by digest and length in partial steps, and both
    sides of the join are plain tables, so its skewed partitions are split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    firsts = staged(keyed.groupBy("digest", "size").agg(F.min("page_id").alias("first")), "payloads")
    revisit = (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return keyed.join(firsts, ["digest", "size"]).select(
        "page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(found: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` as one gzip stream per partition; the stored names of finished files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)
        name, out, packer = f"whole-{uuid.uuid4().hex}.warc.gz", None, zlib.compressobj(6, zlib.DEFLATED, GZIP)
        for batch in slices(batches, "html"):
            if out is None:
                filesystem.create_dir(base, recursive=True)
                out = filesystem.open_output_stream(f"{base}/{name}", compression=None)
            for row in batch.to_pylist():
                payload = row["html"].encode("utf-8", "surrogatepass")
                out.write(packer.compress(record(row["page_id"], row["url"], payload, row["refers_to"], row["revisit"])))
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"name": pa.array([name])})

    return staged(found.mapInArrow(run, "name string"), "archives")


def _per_file(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The names of ``files``, each in a partition of its own."""
    names = sorted(r.name for r in files.select("name").collect())
    rows = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    return rows.repartitionById(max(1, len(names)), F.col("k"))


def normalise(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Rewrite each whole-stream file of ``folder`` with a member a record and a sidecar index.

    Returns the stored names (name, records). A line of the index ``<name>.idx`` is offset, length,
    type and id of a record, with tabs between. Tasks hold a bounded piece of a record at a time; a
    task that is repeated writes files of new names, and only returned ones count.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for source in batch["name"].to_pylist():
                name, count = f"members-{uuid.uuid4().hex}.warc.gz", 0
                with (filesystem.open_input_stream(f"{base}/{source}", compression=None) as whole,
                      filesystem.open_output_stream(f"{base}/{name}", compression=None) as out,
                      filesystem.open_output_stream(f"{base}/{name}.idx", compression=None) as index):
                    for entry in split_members(whole, out):
                        index.write(("\t".join(map(str, entry)) + "\n").encode())
                        count += 1
                yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "records": pa.array([count], pa.int64())})

    return staged(_per_file(spark, files).mapInArrow(run, "name string, records long"), "members")


def read_archives(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Every record of normalised files, each read alone through the index: ``page_id, url,
    record_type, refers_to, payload_bytes, payload_digest, html`` (null for a revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                archive = filesystem.open_input_file(f"{base}/{name}")
                rows, size = [], 0
                with filesystem.open_input_stream(f"{base}/{name}.idx", compression=None) as index:
                    for line in _lines(index):
                        offset, length = map(int, line.split("\t")[:2])
                        rows.append(_row(zlib.decompress(archive.read_at(length, offset), GZIP)))
                        size += len(rows[-1]["html"] or "")
                        if size > CHUNK * 4 or len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return _per_file(spark, files).mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
             "payload_digest string, html string")


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("html", pa.string())])


def _lines(stream) -> Iterator[str]:
    rest = b""
    while piece := stream.read(CHUNK):
        *whole, rest = (rest + piece).split(b"\n")
        yield from (x.decode() for x in whole)


def _row(data: bytes) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    named = headers(head)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(headers(http)["content-length"])
    digest = named["warc-payload-digest"].removeprefix("sha1:")
    revisit = named["warc-type"] == "revisit"
    if not revisit:
        payload = payload[:size]
        if len(payload) != size or base32_sha1(payload) != digest:
            raise ValueError(f"record {named['warc-record-id']} is damaged")
    return {"page_id": _page_of(named["warc-record-id"]), "url": named.get("warc-target-uri"), "record_type": named["warc-type"],
            "refers_to": _page_of(named["warc-refers-to"]) if revisit else None, "payload_bytes": size,
            "payload_digest": digest, "html": None if revisit else payload.decode("utf-8", "surrogatepass")}


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write whole-stream archives of ``pages``, normalise them and read all records back.

    Extra columns are ignored; a null url has no target line; an empty table gives no records.
    """
    spark, folder = pages.sparkSession, new_folder(pages.sparkSession, "warc")
    whole = write_archives(records(pages, least_bytes), folder)
    return read_archives(spark, folder, normalise(spark, folder, whole))
