"""WARC archives as tables of record chunks.

An archive table holds the bytes of WARC records as rows (archive, record, chunk, chunks, data); the rows of an
archive in order of record and chunk are a WARC 1.1 file, byte for byte. A record's header and a small payload
are one row. An oversized payload becomes a row per `CHUNK` bytes, cut from the input buffer without copying it
whole, while one digest runs along the chunks. Reading streams the rows back: single-row records are parsed
where they lie; the chunks of the others are brought together by record, in order, and a running digest and
length are all that is held.

Equal payloads of at least `LEAST` bytes are written once, by the page with the largest id; the others become
revisit records that refer to it.

Defined results: a null payload is an empty one; null target URIs are written as empty; pages that share an id and
a payload are all responses if the id is the largest; pages without an id never are the one referred to unless
all copies lack one; an empty table gives an empty archive; only the id, the URL and the payload are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rulegate.llm.common import by_value
from rulegate.session import materialize, small_side

by_value(__name__)

LEAST = 1_000
CHUNK = 256 * 1024
BATCH_BYTES = 4 * 1024 * 1024
KEEPER_BYTES = 128  # a generous size of a row that says which page keeps a payload

ARCHIVE = "archive int, record long, chunk long, chunks long, data binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, intact boolean"

DATE = "2024-01-01T00:00:00Z"  # fixed, so that the same pages give the same archive
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "none"


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to): which page each payload is stored by.

    The payload's digest and size stand for it. The largest id of each payload that several pages have is a written
    table of its own, as small as there are such payloads; while it is small by count it is broadcast, so that no
    payload moves."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    large = F.col("size") >= least
    keeper = (
        rows.where(large).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    )
    keeper = materialize(keeper, "warc-keepers")
    joined = rows.join(small_side(keeper, keeper.count(), KEEPER_BYTES), ["digest", "size"], "left")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))
    return joined.select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to"))


def header(kind: str, page, url: str, digest: str, size: int, refers) -> bytes:
    """WARC header block; the id of a page is part of its record id."""
    one_line = " ".join(url.split())
    name = NO_ID if page is None else str(page)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Payload-Length: {size}"]
    lines += [f"Content-Length: {0 if kind == 'revisit' else size}", "", ""]
    return "\r\n".join(lines).encode()


def chunks_of(head: bytes, payload: memoryview, chunk: int = CHUNK) -> Iterator[bytes]:
    """A record's rows: header and payload together while they fit, else the header and the payload piecewise;
    the record's end goes with its last row."""
    end = b"\r\n\r\n"
    if len(payload) <= chunk:
        yield head + bytes(payload) + end
        return
    yield head
    for at in range(0, len(payload), chunk):
        part = bytes(payload[at : at + chunk])
        yield part + end if at + chunk >= len(payload) else part


def archive(planned: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The archive table of planned pages: one archive per task, records in the order the task meets them. The
    caller writes it once and reads that."""

    def task(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        record = 0
        held: list[tuple] = []
        size = 0

        def rows():
            columns = list(zip(*held))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["archive", "record", "chunk", "chunks", "data"])
            held.clear()
            return batch

        for batch in batches:
            payloads = batch.column(2)
            for k, (page, url, digest, length, refers) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5)])):
                kind = "response" if refers is None else "revisit"
                payload = memoryview(b"") if refers is not None else memoryview(payloads[k].as_buffer())
                sha = hashlib.sha1()
                for at in range(0, len(payload), chunk):
                    sha.update(payload[at : at + chunk])
                if refers is None and sha.hexdigest() != digest:
                    raise ValueError(f"payload of page {page} changed while it was archived")
                parts = 1 if len(payload) <= chunk else 1 + -(-len(payload) // chunk)
                for j, data in enumerate(chunks_of(header(kind, page, url, digest, length, refers), payload, chunk)):
                    held.append((number, record, j, parts, data))
                    size += len(data)
                    if size >= BATCH_BYTES:
                        yield rows()
                        size = 0
                record += 1
        if held:
            yield rows()

    return planned.mapInArrow(task, ARCHIVE)


class Reader:
    """Parses one record from its chunks as they come: header first, then a running digest and length."""

    def __init__(self):
        self.fields: dict[str, str] | None = None
        self.head = b""
        self.sha, self.seen = hashlib.sha1(), 0

    def feed(self, data: bytes) -> None:
        view = memoryview(data)
        if self.fields is None:
            self.head += data
            cut = self.head.find(b"\r\n\r\n")
            if cut < 0:
                return
            lines = self.head[:cut].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            self.fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            self.length = int(self.fields["content-length"])
            view, self.head = memoryview(self.head)[cut + 4 :], b""
        part = view[: max(0, self.length - self.seen)]
        self.sha.update(part)
        self.seen += len(part)

    def row(self) -> tuple:
        f = self.fields
        if f is None or self.seen != self.length:
            raise ValueError("a record ends early")
        number = lambda urn: None if urn.endswith(f":{NO_ID}>") else int(urn.rsplit(":", 1)[1].rstrip(">"))
        said = f["warc-payload-digest"].removeprefix("sha1:")
        if f["warc-type"] == "revisit":
            return number(f["warc-record-id"]), int(f["warc-payload-length"]), said, "revisit", number(f["warc-refers-to"]), f["warc-target-uri"], True
        digest = self.sha.hexdigest()
        return number(f["warc-record-id"]), self.seen, digest, f["warc-type"], None, f["warc-target-uri"], digest == said


def read_records(stored: DataFrame) -> DataFrame:
    """One row per record of an archive table. `intact`: the payload's digest is the one in the header."""

    def task(batches):
        reader, key = None, None
        out: list[tuple] = []

        def rows():
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target", "intact"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        for batch in batches:
            data = batch.column(4)
            archives, records = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, mine in enumerate(zip(archives, records)):
                if mine != key:
                    if reader:
                        out.append(reader.row())
                    reader, key = Reader(), mine
                reader.feed(data[k].as_py())
            if out:
                yield rows()
        if reader:
            out.append(reader.row())
            yield rows()

    whole = stored.where("chunks = 1")
    parts = stored.where("chunks > 1").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return whole.mapInArrow(task, RECORDS).union(parts.mapInArrow(task, RECORDS))


def write_archive(planned: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """Write the archive table to a shared folder and read it back."""
    archive(planned, chunk).write.parquet(path)
    return planned.sparkSession.read.schema(ARCHIVE).parquet(path)


def export(spark: SparkSession, path: str, number: int) -> Iterator[bytes]:
    """The bytes of one archive in order, row by row: write them to a file and it is a .warc file."""
    rows = spark.read.schema(ARCHIVE).parquet(path).where(F.col("archive") == number).orderBy("record", "chunk").select("data")
    for row in rows.toLocalIterator():
        yield bytes(row[0])
