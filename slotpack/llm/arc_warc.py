"""Conversion of legacy ARC archives to WARC, with revisit records for repeated payloads.

ARC files are parsed by the header fields of their version and by declared lengths. A record keeps its
URL, address and time; its identifier follows from archive and offset, its type from the URL and the
block (version block: warcinfo, HTTP response: response, else resource), its digests from the bytes.
Of responses with equal payloads (SHA-256 and length) the one with the largest page id keeps the
payload; the others become revisit records that name it. WARC files are written by Spark's text
writer, whose line separator is the pair of line ends that closes a record, and read back by declared
lengths.

Hot payloads: groups are pre-aggregated, and the join back is the skew-safe lookup. Files hold at most
FILE_BYTES on average, so reading one takes bounded memory.

Defined results: null html is an empty payload; a null page id is smaller than all others; a record
cut off by the end of its archive is converted with the bytes that are there and WARC-Truncated; lines
that are no header are skipped; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotpack.llm import archives as ar
from slotpack.llm.common import lookup, store
from slotpack.session import table_path

FILE_BYTES = 16 << 20
#: Payloads of fewer bytes are never revisits.
REVISIT_FROM = 0
ARCHIVE = "archive string, content binary"
PAGE_FIELD = "X-Page-Id"
_DATE = "20080430204825"
_RECORD = ("archive string, offset long, record_id string, type string, url string, address string, date string, "
           "content_type string, whole boolean, page_id long, payload_bytes long, payload_sha1 string, "
           "payload_sha256 binary, block binary")


def arc_archives(pages: DataFrame) -> DataFrame:
    """Stand-in input: ARC files of about 4 MB (versions 1 and 2 in turn) that hold the pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, found, size = TaskContext.get().partitionId(), 0, [], 0

        def emit() -> pa.RecordBatch:
            name, version = f"part-{part:06d}-{number:06d}.arc", 1 + number % 2
            content = ar.arc_version_block(name, version, _DATE) + b"".join(
                ar.arc_record(version, f, b) for f, b in found)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())],
                                              ["archive", "content"])

        for b in batches:
            for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                url = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url or "unknown:")
                named = "" if page_id is None else f"{PAGE_FIELD}: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{named}\r\n"
                block = head.encode() + (html or "").encode("utf-8", "surrogatepass")
                found.append(({"URL": url, "IP-address": "192.0.2.1", "Archive-date": _DATE,
                               "Content-type": "text/html", "Result-code": "200"}, block))
                size += len(block)
                if size >= 4 << 20:
                    yield emit()
                    number, found, size = number + 1, [], 0
        if found:
            yield emit()

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, ARCHIVE)


def arc_records(archives: DataFrame) -> DataFrame:
    """Parsed and typed records of ARC files given as (archive, content)."""
    names = [c.split()[0] for c in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            pa.field(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[k])
            for n, k in (c.split() for c in _RECORD.split(", "))])
        for b in batches:
            for name, content in zip(b.column("archive").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [_typed(name or "", r) for r in ar.read_arc(content or b"")]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    return archives.select("archive", "content").mapInArrow(run, _RECORD)


def _typed(name: str, r: ar.ArcRecord) -> tuple:
    url, http = r.fields["URL"], ar.http_parts(r.block)
    kind = "warcinfo" if url.startswith("filedesc://") else "response" if http else "resource"
    payload = http[1] if kind == "response" else r.block
    page = ar.http_field(http[0], PAGE_FIELD) if http else None
    return (name, r.offset, ar.record_id(name, r.offset), kind, url, r.fields["IP-address"],
            ar.iso_date(r.fields["Archive-date"]), r.fields["Content-type"], r.whole,
            int(page) if page and page.lstrip("-").isdecimal() else None, len(payload), ar.sha1(payload),
            hashlib.sha256(payload).digest(), r.block)


def revisits(records: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Stored (revisit_id, refers_id, refers_url, refers_date) of responses whose payload another one keeps."""
    own = store(records.where((F.col("type") == "response") & (F.col("payload_bytes") >= revisit_from)).select(
        "record_id", "url", "date", "page_id", "payload_bytes", "payload_sha256"), "payloads")
    last = F.max(F.struct("page_id", "record_id", "url", "date"))  # a null id is the smallest
    groups = store(own.groupBy("payload_sha256", "payload_bytes").agg(last.alias("kept"),
                                                                      F.count(F.lit(1)).alias("members"))
                   .where("members > 1"), "repeated")
    met = lookup(own, groups, ["payload_sha256", "payload_bytes"], size="members")
    return store(met.where(F.col("record_id") != F.col("kept.record_id")).select(
        F.col("record_id").alias("revisit_id"), F.col("kept.record_id").alias("refers_id"),
        F.col("kept.url").alias("refers_url"), F.col("kept.date").alias("refers_date")), "revisits")


def warc_records(records: DataFrame, repeated: DataFrame) -> DataFrame:
    """(value): the bytes of each WARC record without its closing line ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(_warc, b.to_pylist()), pa.binary())], ["value"])

    met = records.join(repeated, F.col("record_id") == F.col("revisit_id"), "left")
    return met.mapInArrow(run, "value binary")


def _warc(r: dict) -> bytes:
    block, kind = r["block"], "revisit" if r["refers_id"] else r["type"]
    headers = [("WARC-Type", kind), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"])]
    if kind == "warcinfo":
        headers += [("WARC-Filename", r["archive"]), ("Content-Type", "text/plain")]
    else:
        headers += [("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["address"])]
        headers += [("WARC-Payload-Digest", f"sha1:{r['payload_sha1']}")]
        headers += [("Content-Type", r["content_type"] if kind == "resource" else "application/http;msgtype=response")]
    if kind == "revisit":
        headers += [("WARC-Profile", ar.REVISIT_PROFILE), ("WARC-Refers-To", r["refers_id"]),
                    ("WARC-Refers-To-Target-URI", r["refers_url"]), ("WARC-Refers-To-Date", r["refers_date"])]
        block = ar.http_parts(block)[0]
    if not r["whole"]:
        headers += [("WARC-Truncated", "unspecified")]
    return ar.warc_record([*headers, ("WARC-Block-Digest", f"sha1:{ar.sha1(block)}")], block)


def write_warc(archives: DataFrame, path: str, revisit_from: int = REVISIT_FROM) -> None:
    """Convert ARC files (archive, content) to WARC files in the folder ``path``."""
    records = arc_records(archives)
    sizes = records.agg(F.count(F.lit(1)), F.sum(F.octet_length("block"))).first()
    most = max(1, int(FILE_BYTES * (sizes[0] or 0) / max(1, sizes[1] or 0)))
    values = warc_records(records, revisits(records, revisit_from))
    (values.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n")
     .option("maxRecordsPerFile", most).text(path))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, type, refers_id, page_id, payload_bytes, payload_digest) of the responses and revisits of a folder.

    Length and digest of a response are those of the bytes read; a revisit has its header's digest.
    """
    out = "record_id string, type string, refers_id string, page_id long, payload_bytes long, payload_digest string"
    schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.split() for c in out.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = [_read(h, block) for h, block in ar.read_warc(content.as_py())
                        if h.get("warc-type") in ("response", "revisit")]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, out)


def _read(headers: dict[str, str], block: bytes) -> dict:
    head, payload = ar.http_parts(block) or (b"", block)
    page, again = ar.http_field(head, PAGE_FIELD), headers["warc-type"] == "revisit"
    return {"record_id": headers["warc-record-id"], "type": headers["warc-type"],
            "refers_id": headers.get("warc-refers-to"), "page_id": int(page) if page else None,
            "payload_bytes": None if again else len(payload),
            "payload_digest": headers["warc-payload-digest"].partition(":")[2] if again else ar.sha1(payload)}


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits filled in from what they name."""
    own = store(records, "read")
    kept = store(own.where("type = 'response'"), "responses")
    again = store(own.where("type = 'revisit'").drop("payload_bytes"), "again")
    named = kept.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes")
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"]
    return (kept.withColumn("refers_to", F.lit(None).cast("long")).select(*columns)
            .unionByName(lookup(again, named, ["refers_id"], "left").select(*columns)))


def page_records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Pages as ARC archives, converted to WARC files in the shared folder and read back."""
    path = table_path(pages.sparkSession, "warc")
    write_warc(arc_archives(pages), path, revisit_from)
    return resolved(read_warc(pages.sparkSession, path))
