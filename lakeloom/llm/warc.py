"""WARC archives: a writer, and a splittable reader.

**Writer.** Every record is its own gzip member. Of records with equal payloads (of at
least ``least_bytes``) that with the largest id is written as a response, the others
as revisits that refer to it; equality is by the payload's SHA-1, found by an
aggregation whose result is joined back, and only groups of at least two take part
in that join. A task writes its rows to one file of its own name and returns the name,
so files of lost or repeated attempts are never read.

**Reader.** Archives are cut into byte ranges. A task scans its range for the gzip
magic bytes, takes each place as a candidate member and decodes its header: only a
member whose text begins with a WARC version line counts. A range owns the records
that start inside it and reads past its end to finish the last one. After a record the
scan goes on behind its member, so bytes inside a record aren't candidates; a range
that begins within a record meets its remaining bytes only, where a payload that is
itself a WARC archive, stored uncompressed, could pass for records.

Members are decompressed in pieces of ``CHUNK`` bytes, so a task holds one record at a
time. A record that breaks off raises.

Defined cases: null payloads are empty; empty payloads equal each other. A null id
is written as such, is never referred to and is always a response. Rows that repeat
an id and a payload are records each, responses if theirs is the largest id. Null
URLs are empty; control characters in URLs are percent-encoded. An empty table makes
no archives and reads back as no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import prepare_workers, shared_folder, stored
from lakeloom.llm.files import new_file, read_file

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
CHUNK = 1 << 20
PEEK = 512
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def id_of(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member; a revisit holds the HTTP header only."""
    http = HTTP.format(len(payload)).encode()
    block = http if refers_to is not None else http + payload
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(page_id)}",
             f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives; the manifest has a row per file: uri, bytes, records."""
    spark = pages.sparkSession
    prepare_workers(spark)
    folder = folder or shared_folder(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("sha1", F.sha1("payload"))
    groups = keyed.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= least_bytes)).groupBy("sha1").agg(
        F.max("page_id").alias("target"), F.min("page_id").alias("other")).where("other < target").select("sha1", "target")
    groups = stored(groups, "warc-groups")  # its size is then known: Spark broadcasts it only below its threshold
    if not groups.isEmpty():
        keyed = keyed.join(groups, "sha1", "left")
        keyed = keyed.withColumn("refers_to", F.when(F.octet_length("payload") >= least_bytes, F.nullif("target", "page_id")))
    else:
        keyed = keyed.withColumn("refers_to", F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = 0
        first = next(batches, None)
        if first is None:
            return
        with new_file(folder, f"part-{TaskContext.get().partitionId():06d}") as (uri, out):
            batch = first
            while batch is not None:
                for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4))):
                    raw = record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py() if page_id.is_valid else None)
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
                batch = next(batches, None)
        if n:
            yield pa.RecordBatch.from_pydict({"uri": [uri], "bytes": [size], "records": [n]})

    return stored(keyed.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "uri string, bytes long, records long"), "warc-manifest")


class Member:
    """Decompresses the gzip member at ``start`` piece by piece."""

    def __init__(self, source, start: int, chunk: int = CHUNK):
        self.source, self.at, self.chunk = source, start, chunk
        self.zip, self.held = zlib.decompressobj(31), b""

    def more(self, size: int) -> bytes:
        """Up to ``size`` further bytes of text; empty at the end of the member."""
        while not self.zip.eof:
            raw = self.zip.unconsumed_tail
            if not raw:
                raw = self.source.read_at(self.chunk, self.at)
                self.at += len(raw)
                if not raw:
                    raise EOFError("a member breaks off")
            if text := self.zip.decompress(raw, size):
                return text
        return b""

    def end(self) -> int:
        """Where the member ends; all of it must have been read."""
        return self.at - len(self.zip.unused_data)


def starts_record(source, at: int) -> bool:
    """Whether a member that begins with a WARC version line starts at ``at``."""
    try:
        return Member(source, at, PEEK).more(16).startswith(b"WARC/")
    except (zlib.error, EOFError):
        return False


def read_record(source, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block, and the end of the record that starts at ``at``."""
    member, text = Member(source, at), io.BytesIO()
    while part := member.more(CHUNK):
        text.write(part)
    head, _, rest = text.getvalue().partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    length = int(fields["Content-Length"])
    if len(rest) != length + 4:
        raise ValueError(f"the record at {at} has {len(rest)} bytes after its header, not {length + 4}")
    return fields, rest[:length], member.end()


def records(source, start: int, stop: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that start in [start, stop)."""
    base, window = start, b""
    while base < stop:
        window = source.read_at(min(CHUNK, stop - base) + len(MAGIC) - 1, base)
        at = window.find(MAGIC)
        while at >= 0 and base + at < stop:
            if starts_record(source, base + at):
                fields, block, end = read_record(source, base + at)
                yield fields, block
                if end >= base + len(window):
                    base, window = end, b""
                    break
                at = window.find(MAGIC, end - base)
            else:
                at = window.find(MAGIC, at + 1)
        else:
            base += max(1, len(window) - len(MAGIC) + 1) if window else stop


def read(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record: page_id, url, payload (empty for revisits), payload_bytes,
    payload_digest, record_type, refers_to. payload_bytes and payload_digest are the
    full payload's, for revisits as their headers tell."""
    prepare_workers(spark)

    def rows_of(source, start: int, stop: int) -> Iterator[tuple]:
        for fields, block in records(source, start, stop):
            http, _, payload = block.partition(b"\r\n\r\n")
            told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            size = int(http.rsplit(b"Content-Length: ", 1)[1])
            if (kind := fields["WARC-Type"]) == "response" and (len(payload) != size or digest(payload) != told):
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what its header tells")
            refers = fields.get("WARC-Refers-To")
            yield (id_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload, size, told, kind,
                   id_of(refers) if refers else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                with read_file(uri) as source:
                    held, size = [], 0
                    for row in rows_of(source, start, stop):
                        held.append(row)
                        size += len(row[2]) + 200
                        if size >= CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), types)], names=names)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), types)], names=names)

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = manifest.select("uri", starts.alias("start"), "bytes").select("uri", "start", F.least(F.col("start") + split_bytes, "bytes").alias("stop"))
    splits = splits.repartition(max(1, min(splits.count(), 100_000)), "uri", "start")
    return splits.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
