"""ARC parsing, conversion and the round trip through WARC files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a/b c", "20010203040506", b"HTTP/1.0 200 OK\r\n\r\nbody\n\nhttp://not/a header 1 2 3 4"), ("", "20200101000000", b"")]
    out = list(warc.parse_arc(warc.arc_file(records, version)))
    assert [(f["url"], f["date"], c) for f, c in out] == [("http://a/b%20c", records[0][1], records[0][2]), ("unknown:", records[1][1], b"")]


def test_arc_that_is_cut_off_or_of_another_kind():
    data = warc.arc_file([("http://a/", "20010203040506", b"x" * 50)], 1)
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-20]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a/ 0.0.0.0 20010203040506 text/html 3\nabc\n"))


def test_pages_through_both_formats(spark):
    big, tricky = "same " * 40, "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n\r\n\r\n" * 5
    rows = [(3, "u3", big), (1, "u 1\r\nX: y", big), (2, None, big), (None, "u", big), (4, "u4", "tiny"), (5, "u5", "tiny")]
    rows += [(6, "u6", None), (7, "u7", tricky), (8, "u8", tricky), (9, "u9", "é" * 60), (10, "u10", "x" * 300_000), (4, "u4", "tiny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit("mine"))
    out = warc.archive_pages(pages).collect()
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if page_id is not None and len(data) >= 100:
            first[data] = min(first.get(data, page_id), page_id)
    wanted = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        to = first.get(data) if first.get(data) != page_id else None
        wanted.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if to else "response", to))
    found = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert warc.archive_pages(pages.limit(0)).count() == 0
