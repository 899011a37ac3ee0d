"""Bytes of legacy ARC and of WARC archives: reading by declared lengths, writing of records."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

#: Header fields of an ARC record by version (fixed values of the format).
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
END = b"\r\n\r\n"


@dataclass(frozen=True)
class ArcRecord:
    """One record of an ARC file; ``whole`` is False where the file ends before the declared length."""

    offset: int
    fields: dict[str, str]
    block: bytes
    whole: bool


def _arc_header(line: bytes, names: list[str]) -> dict[str, str] | None:
    """Fields of a header line, None where it is none. Only the URL may hold further spaces."""
    values = line.decode("utf-8", "surrogateescape").rstrip("\r").rsplit(" ", len(names) - 1)
    if len(values) != len(names) or not values[0] or not values[-1].isdecimal():
        return None
    return dict(zip(names, values, strict=True))


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, the version block first.

    The version block's own header has the fields of version 1; the first line of its text names the
    version of all later headers. A line that is no header is skipped.
    """
    names, at = ARC_FIELDS[1], 0
    while at < len(data):
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        fields = _arc_header(data[at:stop], names)
        if fields is None and data[at:at + 11] == b"filedesc://":  # a version block in the form of version 2
            fields = _arc_header(data[at:stop], ARC_FIELDS[2])
        if fields is None:
            at = stop + 1
            continue
        size = int(fields["Archive-length"])
        block = data[stop + 1:stop + 1 + size]
        yield ArcRecord(at, fields, block, len(block) == size)
        if fields["URL"].startswith("filedesc://"):
            names = ARC_FIELDS.get(int(block[:1]) if block[:1].isdigit() else 1, ARC_FIELDS[1])
        at = stop + 1 + size


def arc_version_block(name: str, version: int, date: str) -> bytes:
    text = f"{version} 0 slotpack\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(text)}\n".encode() + text + b"\n"


def arc_record(version: int, fields: dict[str, str], block: bytes) -> bytes:
    """One ARC record; fields that are not given are ``-``."""
    values = [fields.get(n, "-") for n in ARC_FIELDS[version][:-1]]
    return f"{' '.join(values)} {len(block)}\n".encode("utf-8", "surrogatepass") + block + b"\n"


def sha1(data: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, offset: int) -> str:
    """The same identifier for a record of an archive however often it is converted."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{archive}\n{offset}'.encode()).digest(), version=4)}>"


def iso_date(arc_date: str) -> str:
    """14 (or fewer) digits of an ARC date as a WARC date; what is missing is the earliest."""
    d = "".join(c for c in arc_date if c.isdecimal())[:14]
    d += "00010101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """(header with its blank line, payload) of an HTTP response; None where the block is none."""
    if not block.startswith(b"HTTP/"):
        return None
    head, blank, payload = block.partition(END)
    return (head + blank, payload) if blank else (head + END, b"")


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(CRLF)[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record without the two line ends that close it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + END + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, by its declared length."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(END, at)
        if stop < 0:
            return
        lines = data[at:stop].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = stop + len(END)
        size = int(headers["content-length"])
        yield headers, data[begin:begin + size]
        at = begin + size
