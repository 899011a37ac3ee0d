import base64
import hashlib

from pyspark.sql import functions as F

from slotpack.llm import arc_warc
from slotpack.llm import archives as ar
from slotpack.session import table_path

PAGES = "page_id long, url string, html string"


def _expected(rows, least=0):
    last = {}
    for i, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        again = len(data) >= least and last[h or ""] != (-1 if i is None else i)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response",
                    last[h or ""] if again else None))
    return sorted(map(str, out))


def test_pages_survive_the_round_trip(spark):
    rows = [(i, f"<html>{i % 5}</html>\r\n\r\nWARC/1.1\r\n") for i in range(60)] + \
           [(100 + i, "same") for i in range(200)] + [(500, None), (501, ""), (502, "é" * 300_000), (None, "no id"),
                                                      (504, "\r\n\r\n"), (505, "HTTP/1.1 200\r\n\r\nx")]
    pages = spark.createDataFrame([(i, None if i == 500 else f"http://h/{i} a\nb", h) for i, h in rows], PAGES) \
        .withColumn("offset", F.lit(1)).withColumn("block", F.lit("x"))
    for least in (0, 5):
        got = sorted(map(str, map(tuple, arc_warc.page_records(pages, least).collect())))
        assert got == _expected(rows, least)


def test_empty_table(spark):
    assert arc_warc.page_records(spark.createDataFrame([], PAGES)).collect() == []


def test_both_versions_and_odd_records(spark):
    one = {"URL": "http://a/x y", "IP-address": "1.2.3.4", "Archive-date": "19970102030405", "Content-type": "text/html"}
    dns = {"URL": "dns:a", "IP-address": "1.2.3.4", "Archive-date": "1997", "Content-type": "text/dns"}
    block = b"HTTP/1.0 200 OK\nno blank line"
    for version in (1, 2):
        data = ar.arc_version_block("f.arc", version, "19970101000000") + ar.arc_record(version, one, block) + \
            b"not a header\n" + ar.arc_record(version, dns, b"\xff\xfe raw") + ar.arc_record(version, one, b"cut short")[:-4]
        found = list(ar.read_arc(data))
        assert [r.fields["URL"] for r in found][1:] == ["http://a/x y", "dns:a", "http://a/x y"]
        assert [r.whole for r in found] == [True, True, True, False] and found[2].block == b"\xff\xfe raw"
        path = table_path(spark, "warc-test")
        arc_warc.write_warc(spark.createDataFrame([("f.arc", bytearray(data))], "archive string, content binary"), path)
        raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
        records = list(ar.read_warc(raw))
        assert sorted(h["warc-type"] for h, _ in records) == ["resource", "resource", "response", "warcinfo"]
        by_type = {h["warc-type"]: (h, b) for h, b in records}
        assert by_type["response"][0]["warc-date"] == "1997-01-02T03:04:05Z" and by_type["response"][1] == block
        assert by_type["warcinfo"][0]["warc-record-id"] == ar.record_id("f.arc", 0)
        assert any(b == b"\xff\xfe raw" and h["warc-target-uri"] == "dns:a" for h, b in records)
        assert sum("warc-truncated" in h for h, _ in records) == 1
        assert all(h["warc-block-digest"] == f"sha1:{ar.sha1(b)}" for h, b in records)


def test_dates():
    assert ar.iso_date("1997") == "1997-01-01T00:00:00Z"
    assert ar.iso_date("20080430204825") == "2008-04-30T20:48:25Z"
