"""Legacy crawl archives (ARC) to WARC, and back from WARC.

ARC files are parsed by their version's URL record: version 1 has five fields,
version 2 ten, both ending in the declared length, which alone says where a
record stops.  For each record the equivalent WARC one is synthesised: a record
id and a date from the URL, the 14-digit timestamp and the content, digests of
block and payload, and a type.  Of equal payloads of ``MIN_REVISIT`` bytes or
more, the one with the smallest key is a ``response``; the others become
``revisit`` records that name it and carry the HTTP header only.

WARC files are written through Spark's own text writer, whose line separator is
the two line breaks that end a WARC record, so they go to any store that Spark
reaches, are ordinary ``.warc`` text inside, and survive lost executors by the
writer's commit.  They are read back whole, file by file, by declared lengths.

Payloads move once, in a join on their digest that adaptive execution splits
where one payload is very common.  Null html counts as empty, a null URL as
``unknown:``.  Rows of equal key and payload are responses alike.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import ship
from palisade.session import scratch_path

MIN_REVISIT = 100
#: Records of one ARC or WARC file, so that no file outgrows a reader.
RECORDS_PER_FILE = 2_000
_ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length"],
}
_SEPARATOR = "\r\n\r\n"


def arc_file(records: list[tuple[str, str, bytes]], version: int) -> bytes:
    """An ARC file of (URL, 14-digit date, content) records."""
    fields = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    head = f"{version} 0 crawl\n{fields}\n\n".encode()
    rest = "" if version == 1 else " 200 - - 0 pages.arc"
    out = [f"filedesc://pages.arc 0.0.0.0 {'0' * 14} text/plain{rest} {len(head)}\n".encode(), head, b"\n"]
    for url, date, content in records:
        url = re.sub(r"\s", lambda m: f"%{ord(m[0]) & 255:02X}", url) or "unknown:"
        out += [f"{url} 0.0.0.0 {date} text/html{rest} {len(content)}\n".encode(), content, b"\n"]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of the records of an ARC file, the version record left out."""
    at, fields = 0, None
    while at < len(data):
        stop = data.index(b"\n", at)
        line = data[at:stop].decode("utf-8", "replace")
        if not line.strip():
            at = stop + 1
            continue
        parts = line.split(" ")
        length = int(parts[-1])
        content = data[stop + 1 : stop + 1 + length]
        if len(content) < length:
            raise ValueError(f"record at byte {at} is cut off")
        if fields is None:
            version = int(content.split(None, 1)[0])
            if not line.startswith("filedesc:") or version not in _ARC_FIELDS:
                raise ValueError("no ARC version record")
            fields = _ARC_FIELDS[version]
        else:
            # A URL may hold spaces; the fields after it may not.
            tail = parts[-(len(fields) - 1) :]
            yield dict(zip(fields, [" ".join(parts[: -(len(fields) - 1)]), *tail])), content
        at = stop + 1 + length


def _http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header and payload of a record's content."""
    if content.startswith(b"HTTP/"):
        header, found, payload = content.partition(b"\r\n\r\n")
        if found:
            return header + found, payload
    return b"", content


def arc_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as ARC files (in a column), odd files of version 2, with the keys of their records.

    ARC has no place for a key, so the keys go beside the file, in record order.
    """
    ship(pages)
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for batch in batches:
            for at in range(0, len(batch), 100):
                some = batch.iloc[at : at + 100]
                records = []
                for link, text in zip(some["url"], some["html"]):
                    body = text.encode() if isinstance(text, str) else b""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n\r\n"
                    records.append((link if isinstance(link, str) else "", "20200101000000", head.encode() + body))
                keys = [None if pd.isna(k) else int(k) for k in some["page_id"]]
                yield pd.DataFrame({"keys": [keys], "archive": [arc_file(records, 1 + n % 2)]})
                n += 1

    return rows.mapInPandas(archives, "keys array<long>, archive binary")


def convert(archives: DataFrame) -> DataFrame:
    """The records of ARC files, with what their WARC equivalents need."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, archive in zip(batch["keys"], batch["archive"]):
                rows = []
                for page_id, (fields, content) in zip(keys, parse_arc(archive)):
                    header, payload = _http(content)
                    d = fields["date"]
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    digest = hashlib.sha256(payload).hexdigest()
                    name = f"{fields['url']} {date} {page_id} {digest}"
                    rows.append((page_id, fields["url"], date, fields["ip"], f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", header, payload, len(payload), digest))
                frame = pd.DataFrame(rows, columns=["page_id", "url", "date", "ip", "record_id", "header", "payload", "payload_bytes", "digest"])
                frame["page_id"] = frame["page_id"].astype("Int64")
                yield frame

    return archives.mapInPandas(
        records,
        "page_id long, url string, date string, ip string, record_id string, header binary, payload binary, payload_bytes long, digest string",
    )


def typed(records: DataFrame) -> DataFrame:
    """Add ``refers_to`` and ``refers_id``: the response that a record revisits, else null."""
    first = records.filter(F.col("payload_bytes") >= MIN_REVISIT).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("page_id", "record_id"), F.struct(F.col("page_id").isNull(), "page_id", "record_id")).alias("first")
    )
    first = first.filter("n > 1").select("digest", "first")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return records.join(first, "digest", "left").select(
        *[F.col(c) for c in records.columns],
        F.when(again, F.col("first.page_id")).alias("refers_to"),
        F.when(again, F.col("first.record_id")).alias("refers_id"),
    )


def write_warc(records: DataFrame, folder: str) -> None:
    """Write typed records as WARC files."""
    ship(records)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                revisit = isinstance(r.refers_id, str)
                block = r.header if revisit else r.header + r.payload
                head = [
                    "WARC/1.1",
                    f"WARC-Type: {'revisit' if revisit else 'response'}",
                    f"WARC-Record-ID: <{r.record_id}>",
                    f"WARC-Date: {r.date}",
                    f"WARC-Target-URI: {r.url}",
                    f"WARC-IP-Address: {r.ip}",
                    f"WARC-Payload-Digest: sha256:{r.digest}",
                    f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
                    f"X-Payload-Length: {r.payload_bytes}",
                    *([] if pd.isna(r.page_id) else [f"X-Page-Id: {int(r.page_id)}"]),
                ]
                if revisit:
                    head += [
                        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        f"WARC-Refers-To: <{r.refers_id}>",
                        f"X-Refers-To-Page-Id: {int(r.refers_to)}",
                    ]
                head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
                out.append("\r\n".join(head).encode() + b"\r\n\r\n" + block)
            yield pd.DataFrame({"value": out})

    columns = ["page_id", "url", "date", "ip", "record_id", "header", "payload", "payload_bytes", "digest", "refers_to", "refers_id"]
    text = records.select(*columns).mapInPandas(lines, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", _SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records of a WARC file."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start = stop + 4
        end = start + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where it says")
        yield fields, data[start:end]
        at = end + 4


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Key, target, type, digest, length, reference and payload of each record; digests are checked."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for batch in batches:
            for content in batch["content"]:
                rows = []
                for fields, block in parse_warc(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    revisit = fields["warc-type"] == "revisit"
                    payload = None if revisit else _http(block)[1]
                    if hashlib.sha256(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha256:"):
                        raise ValueError(f"block of {fields['warc-record-id']} doesn't have its digest")
                    if not revisit and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, int(fields["x-payload-length"])):
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
                    number = lambda name: int(fields[name]) if name in fields else None
                    rows.append((number("x-page-id"), fields["warc-target-uri"], int(fields["x-payload-length"]), digest, fields["warc-type"], number("x-refers-to-page-id"), payload))
                frame = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return (
        spark.read.format("binaryFile")
        .load(folder)
        .select("content")
        .mapInPandas(
            records,
            "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
        )
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages through ARC to WARC files and back: what the files say of each page."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_warc(typed(convert(arc_archives(pages))), folder)
    return read_warc(spark, folder).drop("payload")
