"""Operator 6: WARC archives, written with segments and reassembled on reading.

Writing: a page is a ``response`` record: an HTTP head and the UTF-8 payload in chunked
transfer framing. Blocks longer than ``segment_bytes`` go on in ``continuation`` records
with the origin's id and a segment number; the last one has the total length. Of pages
with equal payloads of at least ``revisit_from`` bytes the one with the smallest id is the
response, the others are ``revisit`` records without payload that refer to it.

The archives are text files of Spark's writer, whose line separator is the blank line that
ends a WARC record; so they are valid WARC, gzip-compressed, in the shared folder, and any
store that Spark writes to will do. A record is at most a segment and its head, and a file
ends before ``file_bytes`` of them, however large the pages are.

The response that others refer to has an id made of its page and digest, so that a revisit
knows it without having seen it; ``WARC-Refers-To`` is the id of a record in these archives.
Where rows repeat the response's page and payload none of them is the one, and the field is
left out. ``Page-Refers-To``, an extension field, has the page's number in both cases.

Reading: files are decompressed and parsed as streams, record by record, and rows go on in
batches of bounded bytes; the segments of a record, wherever they lie,
meet by origin id, are put in order, and their length must be the stated total; then the
chunked framing is decoded and the payload's digest compared with the stated one. A missing
segment, a wrong length or digest raises an error.

Nulls: a null html has an empty payload; a null url an empty target. Rows without an id
refer to the smallest id, or are responses where none has an id. Rows that repeat the
smallest id are responses too. An empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import shared_dir

END = b"\r\n\r\n"
#: Bytes of records that a task holds before it hands them on.
BATCH_BYTES = 8 << 20
#: Room for the head of a record when files are cut.
HEAD_BYTES = 1024
RECORD = "record string, page_id bigint, record_type string, refers_to bigint, segment int, total bigint, payload_bytes bigint, payload_digest string, data binary"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        start = line + 2
        if body[start + n : start + n + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as stated")
        out.append(body[start : start + n])
        at = start + n + 2


def _record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _number(page_id: int | None) -> str:
    return "" if page_id is None else str(page_id)


def with_roles(pages: DataFrame, revisit_from: int = 100) -> DataFrame:
    """Adds payload_digest, payload_bytes, refers_to (null for responses) and referred: the id of the response that is referred to, on itself and on its revisits."""
    raw = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    own = pages.select(F.col("page_id").cast("long"), "url", raw.alias("payload"))
    own = own.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # counted by page first: the copies of one row are combined before they meet the other pages of a digest
    by_page = own.where(F.col("payload_bytes") >= revisit_from).groupBy("payload_digest", "page_id").agg(F.count(F.lit(1)).alias("rows"))
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "rows"))
    shared = by_page.groupBy("payload_digest").agg(F.sum("rows").alias("n"), F.min(known).alias("first"))
    name = F.when(F.col("first.rows") == 1, F.concat(F.lit("<urn:page:"), F.col("first.page_id").cast("string"), F.lit(":"), F.col("payload_digest"), F.lit(">")))
    shared = shared.where("n > 1").select("payload_digest", F.col("first.page_id").alias("first"), name.alias("referred"))
    joined = own.join(shared, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def _page_records(row: dict, spare: str, segment_bytes: int):
    """The records of one page; ``spare`` is the id of a record that nothing refers to."""
    target = " ".join((row["url"] or "").split())
    fields = {
        "WARC-Type": "response" if row["refers_to"] is None else "revisit", "WARC-Record-ID": spare, "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{row['payload_digest']}", "Content-Type": "application/http; msgtype=response",
    }
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if row["refers_to"] is not None:
        fields |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": row["referred"], "Page-Refers-To": row["refers_to"],
        }
        yield _record(fields, head + b"Content-Length: %d\r\n\r\n" % row["payload_bytes"])
        return
    record = fields["WARC-Record-ID"] = row["referred"] or spare
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(row["payload"])
    if len(block) > segment_bytes:
        fields["WARC-Segment-Number"] = 1
    yield _record(fields, block[:segment_bytes])
    for k, start in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        yield _record({
            "WARC-Type": "continuation", "WARC-Record-ID": f"{record[:-1]}-{k}>", "WARC-Date": fields["WARC-Date"], "WARC-Segment-Origin-ID": record,
            "WARC-Segment-Number": k, "WARC-Segment-Total-Length": len(block) if start + segment_bytes >= len(block) else None,
        }, block[start : start + segment_bytes])


def _bounded(rows, size, batch):
    """Batches of about BATCH_BYTES of ``rows``, made by ``batch``; ``size`` tells the bytes of one."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += size(row)
        if held >= BATCH_BYTES:
            yield batch(out)
            out, held = [], 0
    if out:
        yield batch(out)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 32768, revisit_from: int = 100, file_bytes: int = 64 << 20) -> None:
    def run(batches):
        part = TaskContext.get().partitionId()

        def made():
            count = 0
            for batch in batches:
                for i in range(batch.num_rows):
                    count += 1
                    row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                    yield from _page_records(row, f"<urn:page:{_number(row['page_id'])}:{part}-{count}>", segment_bytes)

        yield from _bounded(made(), len, lambda out: pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"]))

    rows = with_roles(pages, revisit_from).select("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to", "referred").mapInArrow(run, "value binary")
    writer = rows.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip")
    writer.option("maxRecordsPerFile", max(1, file_bytes // (segment_bytes + HEAD_BYTES))).text(path)


def records(stream):
    """The records of an archive, as (fields, block), from a file-like object of bytes."""
    while stream.readline():  # the version
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(": ")
            fields[key] = value
        n = int(fields["Content-Length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != END:
            raise ValueError(f"record {fields.get('WARC-Record-ID')} is not as long as stated")
        yield fields, block


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def read_records(spark, path: str) -> DataFrame:
    """One row for each record; those of one segment are decoded, others carry their segment."""

    def row_of(fields: dict[str, str], block: bytes) -> dict:
        kind, number = fields["WARC-Type"], fields.get("WARC-Segment-Number")
        record = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
        page = record.split(":")[2]
        row = {"record": record, "page_id": int(page) if page else None, "segment": int(number) if number else None, "record_type": None if kind == "continuation" else kind}
        row["total"] = int(fields["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in fields else None
        row["payload_digest"] = fields["WARC-Payload-Digest"].partition(":")[2] if kind != "continuation" else None
        if kind == "revisit":
            row["refers_to"] = int(fields["Page-Refers-To"])
            row["payload_bytes"] = int(block.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        elif number:
            row["data"] = block
        else:
            row["payload_bytes"] = _verified(record, _payload(block), row["payload_digest"])
        return row

    def run(batches):
        def rows():
            for batch in batches:
                for content in batch.column(0):
                    with gzip.open(pa.BufferReader(content.as_buffer())) as stream:
                        for fields, block in records(stream):
                            yield row_of(fields, block)

        yield from _bounded(rows(), lambda row: 256 + len(row.get("data", b"")), lambda out: pa.RecordBatch.from_pylist(out, schema=schema))

    schema = pa.schema([
        ("record", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int32()),
        ("total", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary()),
    ])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def _verified(record: str, payload: bytes, digest: str) -> int:
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {record} has another digest than stated")
    return len(payload)


def reassembled(rows: DataFrame) -> DataFrame:
    """Joins the segments of each record; rows (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    whole = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["parts"]:
                    parts = row["parts"]
                    block = b"".join(p["data"] for p in parts)
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != row["total"]:
                        raise ValueError(f"{row['record']} lacks a segment, or its segments are not as long as stated")
                    row["payload_bytes"] = _verified(row["record"], _payload(block), row["payload_digest"])
                out.append({k: row[k] for k in whole})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    parts = F.sort_array(F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "data"))))
    grouped = rows.groupBy("record").agg(*(F.max(c).alias(c) for c in [*whole, "total"]), parts.alias("parts"))
    return grouped.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archived_pages(pages: DataFrame, segment_bytes: int = 32768, revisit_from: int = 100) -> DataFrame:
    """Writes all pages to new archives in the shared folder and reads them back."""
    spark, path = pages.sparkSession, shared_dir(pages.sparkSession)
    write_archives(pages, path, segment_bytes, revisit_from)
    return reassembled(read_records(spark, path))
