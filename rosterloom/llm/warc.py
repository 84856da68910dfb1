"""WARC: a converter of legacy ARC archives, and a writer and reader of WARC archives.

An ARC file begins with a version block (``filedesc://`` and a line with the version), which tells
how the header lines of its records are made: version 1 has url, IP address, date, content type and
length, version 2 also result code, checksum, location, offset and file name before the length. The
declared length alone says where a record's content ends. ``convert`` parses both and synthesises
what WARC has and ARC hasn't: a record id, an ISO timestamp, the record type and the payload digest.
Of records with equal payloads the one with the smallest page id is a response; the others become
revisits that refer to it. A record id is made of the archive's name and the record's place in it, so rows that
repeat a page id have ids of their own; the converted records are written once, so every later step
sees the same ids. A revisit names its response by record id, as the standard has it, and in a
field of its own by page id.

Archives are written by Spark's own text writer with the record terminator as its line separator,
gzipped: each file is a valid compressed WARC file, one task writes and one task reads it as a
stream, and a lost task is repeated by the commit protocol, in any store Spark can reach. The reader
joins what the separator cut and goes by the declared lengths, so payloads may hold the separator.
Memory is bounded by a record (and an ARC chunk of ``ARC_BYTES``).

Equal payloads are found on rows of ids and digests only. The rows that revisit are written, then joined to the
records by record id: Spark broadcasts them if their known size allows, else shuffles by ids that are all different,
so a payload that a third of all pages share never meets in one task with its content.

Cases: null html is an empty payload; a null url is written as ``urn:null``, white space and control
characters in a url are percent-encoded; a null page id is never referred to and revisits if an
equal payload has an id; rows with the same id and payload are all responses or all revisits;
payloads smaller than ``least`` bytes are never revisits; an empty table gives no records; columns
beside page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import store

END = b"\r\n\r\n"
#: An ARC chunk is closed when it has so many bytes.
ARC_BYTES = 1 << 20
ARC_DATE = "20240101000000"
ADDRESS = "0.0.0.0"
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: A field of this writer: the page id of the response that a revisit refers to.
REFERS_TO_PAGE = "X-Refers-To-Page-Id"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
RECORD = "page_id bigint, uri string, date string, digest string, payload_bytes bigint, head binary, body binary, record_id string"


@dataclass
class ArcRecord:
    """One record of an ARC file; the fields of version 2 are None in version 1."""

    url: str
    address: str
    date: str
    mime: str
    content: bytes
    offset: int
    result: str | None = None
    checksum: str | None = None


def arc_header(url: str, mime: str, length: int, version: int, offset: int, name: str, checksum: str = "-") -> bytes:
    middle = "" if version == 1 else f" 200 {checksum} - {offset} {name}"
    return f"{url} {ADDRESS} {ARC_DATE} {mime}{middle} {length}\n".encode()


def arc_start(name: str, version: int) -> bytes:
    block = f"{version} 0 rosterloom\n{FIELDS[version]}\n".encode()
    return arc_header(f"filedesc://{name}", "text/plain", len(block), version, 0, name) + block


def parse_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block, by their declared lengths."""
    at, version, size = 0, 0, len(content)
    while at < size:
        if content[at] in b"\r\n":
            at += 1
            continue
        stop = content.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"ARC header at {at} has no end")
        line = content[at:stop].decode("utf-8", "surrogateescape").rstrip("\r")
        fields = line.rsplit(" ", 9 if version == 2 or (not version and len(line.split(" ")) >= 10) else 4)
        if len(fields) not in (5, 10) or not fields[-1].isdigit():
            raise ValueError(f"not an ARC header line at {at}: {line[:80]!r}")
        begin, length = stop + 1, int(fields[-1])
        if begin + length > size:
            raise ValueError(f"the ARC record at {at} declares {length} bytes, {size - begin} are left")
        if not version:
            if not fields[0].startswith("filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            version = int(content[begin : begin + length].split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
        else:
            more = fields[4:6] if version == 2 else (None, None)
            yield ArcRecord(*fields[:4], content[begin : begin + length], at, *more)
        at = begin + length


def to_arc(pages: DataFrame, chunk: int = ARC_BYTES) -> DataFrame:
    """Legacy archives of ``pages`` (page_id, url, html): rows of name and content; names with an odd
    number are of version 1, the others of version 2. The page id is an HTTP header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get()
        part, number, out = here.partitionId() if here else 0, 0, None

        def closed(name: str, held: bytearray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([bytes(held)], pa.binary())], ["name", "content"])

        for batch in batches:
            for page, url, html in zip(*(batch.column(k) for k in range(3))):
                if out is None:
                    number += 1
                    version, name = 1 if number % 2 else 2, f"pages-{part}-{number}.arc"
                    out = bytearray(arc_start(name, version))
                body = html.as_buffer().to_pybytes() if html.is_valid else b""
                mark = f"X-Page-Id: {page.as_py()}\r\n" if page.is_valid else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{mark}\r\n".encode()
                target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url.as_py()) if url.is_valid and url.as_py() else "urn:null"
                out += b"\n" + arc_header(target, "text/html", len(head) + len(body), version, len(out) + 1, name) + head + body
                if len(out) >= chunk:
                    yield closed(name, out)
                    out = None
        if out is not None:
            yield closed(name, out)

    return pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(run, "name string, content binary")


def _http(content: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """The head with its blank line, the body, and the header fields of an HTTP response."""
    cut = content.find(END)
    if not content.startswith(b"HTTP/") or cut < 0:
        return b"", content, {}
    lines = content[:cut].decode("utf-8", "replace").split("\r\n")[1:]
    return content[: cut + 4], content[cut + 4 :], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def record_id(name: str, offset: int) -> str:
    """A UUID of a record's own, from its archive and its place there."""
    digits = bytearray(hashlib.sha1(f"{name}/{offset}".encode()).digest()[:16])
    digits[6], digits[8] = digits[6] & 0x0F | 0x80, digits[8] & 0x3F | 0x80
    return uuid.UUID(bytes=bytes(digits)).urn


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def convert(arcs: DataFrame) -> DataFrame:
    """The records of ARC archives (name, content) with what WARC needs, see ``RECORD``; archives have different names."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows: list[list] = [[] for _ in names]
                for record in parse_arc(content.as_buffer().to_pybytes()):
                    head, body, fields = _http(record.content)
                    page = fields.get("x-page-id", "")
                    page_id = int(page) if re.fullmatch(r"-?\d+", page) else None
                    d = record.date
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    for column, value in zip(rows, (page_id, record.url, date, digest_of(body), len(body), head, body, record_id(name.as_py(), record.offset))):
                        column.append(value)
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

    return arcs.mapInArrow(run, RECORD)


def with_types(records: DataFrame, least: int = 0) -> DataFrame:
    """``records``, which are written, with columns first and first_record: for a revisit the page id and the record id of
    its response, else null."""
    alike = records.select("record_id", "page_id", "digest", "payload_bytes").filter(F.col("payload_bytes") >= least)
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id"))
    firsts = alike.groupBy("digest").agg(F.min(known).alias("r"), F.count("*").alias("n")).filter("n > 1 AND r IS NOT NULL")
    firsts = store.written(records.sparkSession, firsts.select("digest", F.col("r.page_id").alias("first"), F.col("r.record_id").alias("first_record")), "firsts")
    later = alike.join(firsts, "digest").filter(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    later = store.written(records.sparkSession, later.select("record_id", "first", "first_record"), "revisits")
    return records.join(later, "record_id", "left")


def write(records: DataFrame, path: str) -> None:
    """One WARC record for each row of ``with_types``, into gzipped archives under ``path``."""
    revisit = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<"), "first_record", F.lit(">"))), line(REFERS_TO_PAGE, F.col("first").cast("string")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length("head") + F.when(revisit, 0).otherwise(F.octet_length("body"))).cast("string")),
        F.lit("\r\n"),
    )
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "body"))
    text = F.concat(header.cast("binary"), block).cast("string")
    records.select(text.alias("value")).write.option("compression", "gzip").option("lineSep", END.decode()).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: page_id, payload_bytes, payload_digest,
    record_type, refers_to, uri, payload (null for a revisit). A response whose payload has another
    digest than declared is an error."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def record(header: bytes, block: bytes) -> tuple:
        lines = header.decode("utf-8", "replace").split("\r\n")
        has = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        _, body, fields = _http(block)
        declared, kind = has["warc-payload-digest"].removeprefix("sha1:"), has["warc-type"]
        if kind == "response" and digest_of(body) != declared:
            raise ValueError(f"{has['warc-record-id']}: the payload's digest is not the declared one")
        page = fields.get("x-page-id")
        size = len(body) if kind == "response" else int(fields["content-length"])
        return int(page) if page else None, size, declared, kind, int(has[REFERS_TO_PAGE.lower()]) if kind == "revisit" else None, has["warc-target-uri"], body if kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, need, header = bytearray(), 0, b""
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for piece in batch.column(0):
                held += piece.as_buffer().to_pybytes() + END
                while len(held) >= need:
                    if not header:
                        skip = len(held) - len(held.lstrip(b"\r\n"))
                        cut = held.find(END, skip)
                        if cut < 0:
                            break
                        header = bytes(held[skip:cut])
                        if not header.startswith(b"WARC/"):
                            raise ValueError(f"no WARC record where one should begin: {header[:60]!r}")
                        del held[: cut + 4]
                        need = int(re.search(rb"(?mi)^content-length:\s*(\d+)", header)[1])
                    else:
                        rows.append(record(header, bytes(held[:need])))
                        size += need
                        del held[:need]
                        header, need = b"", 0
                        if size > ARC_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, size = [], 0
        if header or held.strip(b"\r\n"):
            raise ValueError("a WARC archive ends within a record")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    raw = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    return raw.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, uri string, payload binary")


def archive(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` through ARC and WARC archives and back, as ``read`` returns them."""
    records = store.written(spark, convert(to_arc(pages)), "records")
    path = store.place(spark, "warc")
    write(with_types(records, least), path)
    return read(spark, path)


#: The same in DuckDB SQL over the table pages; base32 digits are looked up five bits at a time.
ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM p
), bits AS (
  SELECT page_id, payload_bytes, h,
    list_aggregate(list_transform(range(0, 40), lambda i: right(bin(strpos('0123456789abcdef', h[i + 1]) - 1 + 16), 4)), 'string_agg', '') AS b FROM d
), b32 AS (
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + 16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT, 1)), 'string_agg', '') AS payload_digest FROM bits
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b32
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM f"""
