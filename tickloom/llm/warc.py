"""Operator 5: WARC archives with revisit records, and a normaliser for monolithic gzip files.

Archives arrive as one gzip stream over the whole file, in which nothing can be read without
inflating all before it. The normaliser inflates each such stream once, writes every record as a gzip
member of its own and lists the members in a sidecar index, so that a record is one seek away.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import ArrivingFile, batched, filesystem, make_folder, new_folder, rows_of, stage

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n"
#: Bytes read at a time, and bytes that one step may inflate them to.
CHUNK, STEP = 1 << 18, 1 << 20
#: A file is closed once so many bytes of records are in it.
FILE_BYTES = 64 << 20
#: Compressed bytes that a task reads back.
READ_BYTES = 4 << 20
FILES = pa.schema([("file", pa.string())])
INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])
PAGE_COLUMNS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                "file string, offset long")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone; both state digest and length of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if is_revisit else http + payload
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
              ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", clean(url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to))]
    head = VERSION + END + b"".join(f"{k}: {v}".encode() + END for k, v in fields) + END
    return head + body + END + END


class Inflated:
    """A gzip stream of any size read in bounded steps, through as many members as it has."""

    def __init__(self, source: BinaryIO):
        self.source, self.held, self.machine = source, bytearray(), zlib.decompressobj(31)
        self.ended = self.full = False

    def more(self) -> bool:
        if self.ended:
            return False
        if self.machine.eof:
            data = self.machine.unused_data or self.source.read(CHUNK)
            if not data:
                self.ended = True
                return False
            self.machine = zlib.decompressobj(31)
        else:
            # A full step may have left data, or only its output, inside.
            data = self.machine.unconsumed_tail
            if not data and not self.full:
                data = self.source.read(CHUNK)
                if not data:
                    raise EOFError("the gzip stream ends inside a member")
        out = self.machine.decompress(data, STEP)
        self.full = len(out) == STEP
        self.held += out
        return True

    def line(self) -> bytes:
        """The next line with its end; empty at the end of the stream."""
        while (at := self.held.find(b"\n")) < 0 and self.more():
            pass
        return self.take(at + 1 if at >= 0 else len(self.held))

    def take(self, size: int) -> bytes:
        while len(self.held) < size and self.more():
            pass
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def records_in(stream: Inflated) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields in lower case, body, the whole record as it stands) of each record."""
    while True:
        line = stream.line()
        while line and not line.strip():
            line = stream.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("no record begins here")
        raw, fields = [line], {}
        while (line := stream.line()).strip():
            raw.append(line)
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        body = stream.take(int(fields["content-length"]))
        yield fields, body, b"".join(raw) + END + body + END + END


def page_of(fields: dict[str, str], body: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); a stored payload is measured, not believed."""
    kind = fields["warc-type"]
    head, _, payload = body.partition(END + END)
    page_id = int(fields["x-page-id"]) if "x-page-id" in fields else None
    if kind == "response":
        return page_id, len(payload), digest_of(payload), kind, None
    size = next(int(x.split(b":")[1]) for x in head.split(END) if x.lower().startswith(b"content-length:"))
    return page_id, size, fields["warc-payload-digest"].removeprefix("sha1:"), kind, int(fields["x-refers-to-page"])


def with_first_page(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add `refers_to`: of pages with one payload the smallest page_id, NULL for that page itself.

    Payloads are told apart by their SHA-1 and length. Groups are counted before the shuffle and only
    groups of two or more are kept, so a payload that a third of the pages share is one row here.
    Rows that repeat the smallest page_id are all responses. A NULL page_id revisits the smallest
    that is not NULL; if there is none, the page is a response. Payloads under `min_bytes` are never
    revisits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html"),
                         F.sha1(payload).alias("payload_key"), F.octet_length(payload).alias("payload_size"))
    groups = (pages.where(F.col("payload_size") >= min_bytes).groupBy("payload_key", "payload_size")
              .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_page IS NOT NULL").drop("n"))
    joined = pages.join(groups, ["payload_key", "payload_size"], "left")
    return joined.select("page_id", "url", "html", F.when(
        F.col("page_id").isNull() | (F.col("page_id") != F.col("first_page")), F.col("first_page")).alias("refers_to"))


def write_monolithic(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a WARC record per page, as gzip streams over whole files; returns their names (staged).

    A NULL html is an empty payload. Every task writes its own files, each seen only once whole.
    """
    make_folder(folder)

    def written(batches):
        rows = rows_of(batches)
        row, number = next(rows, None), 0
        part = TaskContext.get().partitionId()
        while row is not None:
            name = f"{folder.rstrip('/')}/crawl-{part:05d}-{number:04d}.warc.gz"
            with ArrivingFile(name) as sink, gzip.GzipFile(fileobj=sink, mode="wb", compresslevel=3, mtime=0) as stream:
                size = 0
                while row is not None and size < file_bytes:
                    page_id, url, html, refers_to = row
                    made = record(page_id, url, (html or "").encode(), refers_to, refers_to is not None)
                    stream.write(made)
                    size += len(made)
                    row = next(rows, None)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([name])], schema=FILES)

    return stage(with_first_page(pages, min_bytes).mapInArrow(written, "file string"), "warc-files")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each monolithic `file` with a gzip member per record; returns the index file, offset, size (staged).

    Streams are inflated once, in bounded steps, and may be larger than memory; one record at a time
    is held. Next to each archive lies its index as a text file (`.idx`), one `offset size` per line.
    """
    make_folder(folder)

    def rewritten(batches):
        def made():
            for (name,) in rows_of(batches):
                store, path = filesystem(name)
                target = f"{folder.rstrip('/')}/{name.rsplit('/', 1)[1]}"
                with store.open_input_stream(path, compression=None) as source, ArrivingFile(target) as sink, ArrivingFile(f"{target}.idx") as index:
                    offset = 0
                    for _, _, raw in records_in(Inflated(source)):
                        member = gzip.compress(raw, 3, mtime=0)
                        sink.write(member)
                        index.write(f"{offset} {len(member)}\n".encode())
                        yield target, offset, len(member)
                        offset += len(member)

        yield from batched(made(), INDEX)

    # One file per task: a number that is asked for is not merged into few tasks, however short the list.
    listed = files.select("file").repartition(max(1, files.count()))
    return stage(listed.mapInArrow(rewritten, "file string, offset long, size long"), "warc-index")


def read_pages(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset of each indexed member.

    Any selection of index rows can be read: members are found by offset, ordered within a task.
    """
    def read(batches):
        def made():
            name, source = None, None
            for file, offset, size in rows_of(batches):
                if file != name:
                    if source:
                        source.close()
                    store, path = filesystem(file)
                    name, source = file, store.open_input_file(path)
                source.seek(offset)
                fields, body, _ = next(records_in(Inflated(pa.BufferReader(source.read(size)))))
                yield *page_of(fields, body), file, offset
            if source:
                source.close()

        yield from batched(made(), PAGES)

    chunk = F.floor(F.col("offset") / READ_BYTES)  # a large archive is read by many tasks
    tasks = -(-(index.agg(F.sum("size")).first()[0] or 1) // READ_BYTES)
    ordered = index.repartition(tasks, "file", chunk).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, PAGE_COLUMNS)


def archived_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, normalise the archives and read them back through the index.

    An empty table writes no file and gives no rows.
    """
    folder = new_folder(spark, "warc")
    return read_pages(normalise(write_monolithic(pages, f"{folder}/whole", min_bytes), f"{folder}/members"))
