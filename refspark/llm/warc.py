"""WARC archives as a chunked record table.

A record is rows of (archive, record_no, chunk_no, last, head, data, digest). A payload of at most CHUNK bytes is one row: its first
`head` bytes are the WARC and HTTP headers, then come the payload and the record's closing line ends. A longer payload is cut, in
the JVM, into rows of CHUNK payload bytes each, the first with the headers and the last with the closing line ends. Concatenated in
that order an archive is a plain WARC/1.1 file. digest is the SHA-256 of the payload up to and with the row's chunk, carried from row
to row, so neither the writer's Python nor a reader ever holds more than a chunk of a record.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, cut, new_folder

#: Payload bytes in a chunk.
CHUNK = 1 << 16
#: Payloads below this size are always stored whole.
LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "archive int, record_no bigint, chunk_no int, last boolean, head int, data binary, digest string"
END = b"\r\n\r\n"
#: Payloads found twice or more that are broadcast, 100 bytes each; beyond it only those of over HOT rows are, at most one for HOT rows.
FEW, HOT = 100_000, 100_000


def plan_records(pages: DataFrame, few: int = FEW, hot: int = HOT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of every row.

    Equal payloads of LEAST bytes or more: rows with the smallest page_id are responses, the others revisit it. A null page_id is never
    the smallest unless all are null, and then all are responses. Null html is empty. Repeated rows are each a record; an empty table
    has none. Other columns aren't read, so their names can't clash.

    The first page of each repeated payload is found over digests alone. If these are few they are broadcast and no html is shuffled;
    else html meets the first pages by a shuffle, but for the payloads of over `hot` rows, whose first pages are broadcast.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = own.filter(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    first = cut(first, "firsts")
    if first.count() <= few:
        out = own.join(F.broadcast(first.drop("n")), "payload_digest", "left")
    else:
        often = F.broadcast(first.filter(F.col("n") > hot).drop("n"))
        rest = own.join(often, "payload_digest", "left_anti").join(first.filter(F.col("n") <= hot).drop("n"), "payload_digest", "left")
        out = own.join(often, "payload_digest").unionByName(rest)
    again = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    return out.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.sha256(f"{page_id}\n{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def headers(page_id: int | None, url: str | None, size: int, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """WARC and HTTP headers of a record, up to its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def chunks(records: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The rows of plan_records' records; an archive is a task's part."""
    schema = to_arrow_schema(T._parse_datatype_string(ROWS))
    final = F.when(F.col("record_type") == "response", F.floor((F.greatest("payload_bytes", F.lit(1)) - 1) / CHUNK).cast("int")).otherwise(0)
    parts = records.withColumn("final", final).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("final"))))
    data = F.when(F.col("record_type") == "response", F.substring("payload", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))).otherwise(F.lit(b""))
    parts = parts.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk_no", (F.col("chunk_no") == F.col("final")).alias("last"), data.alias("data"))
    bounded_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, number, so_far = TaskContext.get().partitionId(), 0, None
        for batch in batches:  # a record's rows follow one another, in one batch or in several
            rows: list[tuple] = []
            for page, url, n, digest, kind, to, chunk, last, part in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                head = b""
                if not chunk:
                    so_far, head = hashlib.sha256(), headers(page, url, n, digest, kind, to, date)
                so_far.update(part)
                rows.append((archive, number, chunk, last, len(head), head + part + END * last, so_far.hexdigest()))
                number += last
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return parts.mapInArrow(run, ROWS)


def write_archives(pages: DataFrame, path: str) -> None:
    chunks(plan_records(pages)).write.option("compression", "zstd").parquet(path)


FOUND = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """FOUND of every record, from its headers; a response's length and digest are taken from its payload and checked against them.

    A record of one row is read where it lies. Rows of longer records are dealt by record and sorted by chunk, for a file may be read by
    several tasks; then they are streamed, so a task holds one batch of chunks.
    """
    rows = spark.read.schema(ROWS).parquet(path)
    alone = (F.col("chunk_no") == 0) & F.col("last")
    long = rows.filter(~alone).repartition("archive", "record_no").sortWithinPartitions("archive", "record_no", "chunk_no")
    schema = to_arrow_schema(T._parse_datatype_string(FOUND))
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fields, digest, size = None, {}, None, 0
        for batch in batches:
            out: list[tuple] = []
            for archive, record, chunk, last, head, data, so_far in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if chunk == 0:
                    at, digest, size = (archive, record), hashlib.sha256(), 0
                    warc, http = data[:head].split(END)[:2]
                    fields = dict(x.split(b": ", 1) for x in warc.split(b"\r\n")[1:])
                    fields |= {b"http " + k: v for k, v in (x.split(b": ", 1) for x in http.split(b"\r\n")[1:])}
                part = memoryview(data)[head : len(data) - len(END) * last]
                digest.update(part)
                size += len(part)
                if digest.hexdigest() != so_far or (last and not data.endswith(END)):
                    raise ValueError(f"record {at}, chunk {chunk}: digest or end differs")
                if last:
                    kind, said = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
                    n, page, first = int(fields[b"http Content-Length"]), fields.get(b"X-Page-Id"), fields.get(b"X-Refers-To-Page-Id")
                    if kind == "response" and (digest.hexdigest() != said or size != n):
                        raise ValueError(f"record {at}: the payload is not what its headers say")
                    out.append((page and int(page), n, said, kind, first and int(first)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.filter(alone).mapInArrow(run, FOUND).union(long.mapInArrow(run, FOUND))


def warc_digest(pages: DataFrame) -> DataFrame:
    """The row of each page that op6's contract asks for: written to archives, and read back."""
    path = new_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
