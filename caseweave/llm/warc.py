"""Web archives: writing pages as WARC records, normalising monolithic gzip files, and reading records by offset.

The writer gives one gzip stream per task over all its records. The normaliser inflates such a stream once, rewrites
every record as a gzip member of its own and writes a sidecar ``.idx`` with a line (offset, length, record id) per record.
The reader seeks to the offsets of a sidecar and inflates one member at a time. None holds more than one record and a
read buffer. Files are opened by URI through Arrow's file systems, under names of their own per task attempt; only
archives that a finished task has reported are read, so a lost executor leaves files that nobody reads.

Of records with equal payloads, that of the smallest page id is the response and the others are revisits that refer to it;
payloads below ``least_bytes`` are all responses. Rows that repeat the response's page and payload are responses as well.
Null html is an empty payload, a null url gives no target line, a null page id makes a revisit where another page has the
payload. An empty table gives no archives. Columns other than these are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.session import fresh_path, stage

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 1 << 20
GZIP = 31  # zlib's window bits for a gzip header
READ_BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1, as payload digests are written."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    number = (record or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the payload's length and digest but no payload."""
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": "2000-01-01T00:00:00Z"}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="!#$&'()*+,/:;=?@[]~%")
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to)
    head["WARC-Payload-Digest"] = f"sha1:{digest(payload)}"
    head["X-Payload-Length"] = str(len(payload))
    head["Content-Type"] = "application/http; msgtype=response"
    block = HTTP_HEAD + (b"" if revisit else payload)
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """The named fields of a record, names in lower case."""
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        if name:
            fields[name.strip().lower()] = value.strip()
    return fields


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) for each record of an inflated stream."""
    buffer = bytearray()

    def fill(upto: int) -> bool:
        while len(buffer) < upto:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            buffer.extend(chunk)
        return True

    while True:
        end = buffer.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(buffer) + 1):
                if buffer:
                    raise ValueError("the archive ends inside a record's head")
                return
            end = buffer.find(b"\r\n\r\n")
        fields = parse_head(bytes(buffer[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        if not fill(size):
            raise ValueError("the archive ends inside a record")
        yield fields, bytes(buffer[:size])
        del buffer[:size]


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip stream of one or more members, in chunks."""
    machine = zlib.decompressobj(GZIP)
    while data := stream.read(CHUNK):
        while data:
            if out := machine.decompress(data, CHUNK):
                yield out
            if machine.eof:
                data, machine = machine.unused_data, zlib.decompressobj(GZIP)
            else:
                data = machine.unconsumed_tail
    if out := machine.flush():
        yield out


def mark_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, sha, refers_to, revisit) per distinct page and payload; payloads are hashed in place and not moved."""
    narrow = pages.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n"))
    one = narrow.groupBy("page_id", "sha").agg(F.max("n").alias("n"))
    first = one.groupBy("sha").agg(F.min("page_id").alias("first"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("n") >= least_bytes), F.col("first"))
    return one.join(first, "sha").select("page_id", "sha", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write (page_id, url, html) as archives of one gzip stream each; returns the stored table (archive)."""
    named = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    marks = mark_revisits(named, least_bytes).filter("refers_to is not null")
    wide = named.withColumn("sha", F.sha1("payload"))
    matched = (wide["sha"] == marks["sha"]) & wide["page_id"].eqNullSafe(marks["page_id"])
    records = wide.join(marks, matched, "left").select(wide["page_id"], "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    files, path = fs.FileSystem.from_uri(name)
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    out, machine = files.open_output_stream(path, compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                out.write(machine.compress(make_record(page_id, url, payload, refers_to, refers_to is not None)))
        if out is not None:
            out.write(machine.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["archive"])

    return stage(records.mapInArrow(run, "archive string"))


def one_task_each(archives: DataFrame) -> DataFrame:
    """Archives dealt over the tasks by name."""
    return archives.repartition(archives.sparkSession.sparkContext.defaultParallelism * 4, "archive")


def normalise(archives: DataFrame, level: int = 6) -> DataFrame:
    """Rewrite each archive with a member per record and a sidecar; returns the stored table (archive) of the new files."""

    def rewrite(name: str) -> str:
        made = name.removesuffix(".warc.gz") + f"-{uuid.uuid4().hex[:8]}.warc.gz"
        files, source = fs.FileSystem.from_uri(name)
        _, path = fs.FileSystem.from_uri(made)
        at = 0
        with files.open_input_stream(source, compression=None) as stream, files.open_output_stream(path, compression=None) as out, files.open_output_stream(path + ".idx", compression=None) as index:
            for fields, record in split_records(inflated(stream)):
                machine = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                member = machine.compress(record) + machine.flush()
                out.write(member)
                index.write(f"{at}\t{len(member)}\t{fields['warc-record-id']}\n".encode())
                at += len(member)
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([rewrite(name)])], names=["archive"])

    return stage(one_task_each(archives).mapInArrow(run, "archive string"))


def sidecar(files: fs.FileSystem, path: str) -> list[tuple[int, int, str]]:
    """(offset, length, record id) of every record of an archive."""
    with files.open_input_stream(path + ".idx", compression=None) as stream:
        lines = stream.read().decode().splitlines()
    return [(int(a), int(n), r) for a, n, r in (line.split("\t") for line in lines)]


def read_records(archives: DataFrame) -> DataFrame:
    """One row per record of normalised archives, found by the sidecars' offsets; digests of responses are taken anew."""

    def row(fields: dict[str, str], record: bytes) -> tuple:
        page, kind = page_of(fields["warc-record-id"]), fields["warc-type"]
        if kind == "revisit":
            return page, int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), kind, page_of(fields["warc-refers-to"])
        block = record[record.index(b"\r\n\r\n") + 4 : -4]
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        return page, len(payload), digest(payload), kind, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, path = fs.FileSystem.from_uri(name)
                rows = []
                with files.open_input_file(path) as source:
                    for offset, length, _ in sidecar(files, path):
                        source.seek(offset)
                        (found,) = split_records(iter([zlib.decompress(source.read(length), GZIP)]))
                        rows.append(row(*found))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return one_task_each(archives).mapInArrow(run, READ_BACK)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back ``pages`` in a folder of the shared work folder."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_records(normalise(write_archives(pages, folder, least_bytes)))
