"""Legacy archive converter: ARC files to WARC records.

ARC comes in two versions. A version line opens each file; after it every record has one header line and a declared length:
version 1 has ``url ip date type length``, version 2 ``url ip date type result checksum location offset filename length``.
Lines are parsed by the version of their file, payloads are cut by the declared length alone. The converter then makes the
WARC records: a record id (a name-based UUID), an ISO timestamp, the type and both digests, with further copies of a
payload as revisit records.

Spark does all reading and writing, so archives may lie in any store that Spark reaches: text files with ``\\n`` as the only
separator hold the exact bytes of UTF-8 records, and each file ends at a record.

Defined cases: a null payload is empty; payloads under ``MIN_REVISIT`` bytes are never revisits; ties do not occur, the
largest id (numbers by size, strings by code point) is the response; ids of any type travel in a header, percent-encoded, and come back in their type; repeated (id, payload) rows are each written, all as the type of their page, and a revisit of
repeated responses names the record id that they share. Without an id a page is written and read back with a null id; it is
a response only if no page with an id has its payload. A record whose header line does not fit its version raises
ValueError. Other columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

MIN_REVISIT = 1000
#: Rough bytes of records in one archive file, and the most records in a WARC file.
FILE_BYTES = 32_000_000
FILE_RECORDS = 10_000
_DATE = "20240101000000"
_BLANK = re.compile(r"[\x00-\x20\x7f]+|\s+")  # header fields are parted by blanks, so a URL can't hold any
_VERSION_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def arc_record(version: int, url: str, body: bytes, date: str = _DATE, ip: str = "0.0.0.0", mime: str = "text/html") -> bytes:
    """One ARC record. ``body`` is the HTTP response: status line, headers, blank line, payload."""
    middle = [] if version == 1 else ["200", "-", "-", "0", "pages.arc"]
    return " ".join([url, ip, date, mime, *middle, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_head(version: int, name: str = "pages.arc") -> bytes:
    """The version record that opens an ARC file."""
    body = f"{version} {0 if version == 1 else 1} converter\n{_VERSION_FIELDS[version]}\n".encode()
    return arc_record(version, f"filedesc://{name}", body, mime="text/plain")


def http_response(payload: bytes, headers: dict[str, str]) -> bytes:
    lines = ["HTTP/1.1 200 OK", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload


def parse_http(body: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = body.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, payload


def parse_arc(data: bytes) -> Iterator[dict]:
    """url, ip, date, mime, body of every record but the version record."""
    at, version = 0, 0
    while at < len(data):
        if data[at] == 10:  # the line end that follows a record
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode().split(" ")
        if end < 0 or not line[-1].isdigit():
            raise ValueError(f"not an ARC header line at byte {at}")
        body = data[end + 1 : end + 1 + int(line[-1])]
        if len(body) < int(line[-1]):
            raise ValueError(f"an ARC record is cut short at byte {at}")
        if line[0].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
        else:
            if len(line) != len(_VERSION_FIELDS.get(version, "").split()):
                raise ValueError(f"not a header line of ARC version {version} at byte {at}")
            yield {"url": line[0], "ip": line[1], "date": line[2], "mime": line[3], "body": body}
        at = end + 1 + len(body)


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest}')}>"


def iso_date(date: str) -> str:
    """14 digits as an ISO timestamp."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(arc: dict, revisit_of: tuple[str, str, str] | None = None) -> bytes:
    """The WARC equivalent of an ARC record; ``revisit_of`` is the id, URL and date of the response whose payload it shares."""
    head, gap, payload = arc["body"].partition(b"\r\n\r\n")
    digest = sha1_base32(payload)
    block = head + gap if revisit_of else arc["body"]
    fields = {
        "WARC-Type": "revisit" if revisit_of else "response",
        "WARC-Record-ID": record_id(arc["url"], arc["date"], sha1_base32(arc["body"])),
        "WARC-Date": iso_date(arc["date"]),
        "WARC-Target-URI": arc["url"],
        "WARC-IP-Address": arc["ip"],
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": sha1_base32(block),
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit_of:
        fields |= dict(zip(("WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date"), revisit_of, strict=True))
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = data[end + 4 : end + 4 + int(fields["content-length"])]
        yield fields, block
        at = end + 4 + len(block) + 4


def unzip(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


_ARC_SCHEMA = "url string, ip string, date string, mime string, body binary, page_id string, payload_bytes long, sha1 string"


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Legacy input made from pages: rows ``content`` are whole ARC file images, versions 1 and 2 in turn, one for each batch."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1
        for batch in batches:
            parts, size = [], 0
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                body = http_response(payload, {"Content-Type": "text/html; charset=utf-8"} | ({} if page is None else {"X-Page-Id": quote(str(page))}))
                record = arc_record(version, _BLANK.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "-"), body)
                parts.append(record)
                size += len(record)
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([arc_head(version) + b"".join(parts)], pa.binary())], ["content"])
                    parts, size, version = [], 0, 3 - version
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([arc_head(version) + b"".join(parts)], pa.binary())], ["content"])
            version = 3 - version

    return pages.select(id_col, url_col, html_col).mapInArrow(write, "content binary")


def arc_records(files: DataFrame, id_type: str = "long") -> DataFrame:
    """Records of ARC files (column ``content``, gzipped or not): header fields, body, page_id (header X-Page-Id as ``id_type``, or null), payload_bytes and sha1 (hex)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse_arc(unzip(content.as_py())):
                    headers, payload = parse_http(r["body"])
                    page = headers.get("x-page-id")
                    rows.append((*r.values(), None if page is None else unquote(page), len(payload), hashlib.sha1(payload).hexdigest()))
                    size += len(r["body"])
                    if size > FILE_BYTES // 4:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return files.select("content").mapInArrow(parse, _ARC_SCHEMA).withColumn("page_id", F.col("page_id").try_cast(id_type))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 4 + [pa.binary(), pa.string(), pa.int64(), pa.string()]
    names = ["url", "ip", "date", "mime", "body", "page_id", "payload_bytes", "sha1"]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def mark_revisits(records: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Records with ``first`` (struct page_id, url, date, body digest): the record with the largest page_id among those of the same payload; null for responses.

    Only digests and ids are aggregated; payloads take part in the join by digest, whose skewed partitions Spark splits.
    """
    large = F.col("payload_bytes") >= min_bytes
    firsts = (
        records.filter(large)
        .groupBy("sha1", "payload_bytes")
        .agg(F.max(F.struct("page_id", "url", "date", F.sha1("body").alias("body_sha1"))).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("sha1").alias("_sha1"), F.col("payload_bytes").alias("_bytes"), "first")
    )
    met = records.join(firsts, (F.col("sha1") == F.col("_sha1")) & (F.col("payload_bytes") == F.col("_bytes")), "left").drop("_sha1", "_bytes")
    own = F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return met.withColumn("first", F.when(~own, F.col("first")))


def warc_text(records: DataFrame) -> Column:
    """A WARC record as text, without its last line end, for UTF-8 payloads."""

    def convert(url: pd.Series, ip: pd.Series, date: pd.Series, mime: pd.Series, body: pd.Series, first: pd.DataFrame) -> pd.Series:
        out = []
        for u, i, d, m, b, of_url, of_date, of_sha1 in zip(url, ip, date, mime, body, first["url"], first["date"], first["body_sha1"], strict=True):
            of = None
            if isinstance(of_sha1, str):
                of = (record_id(of_url, of_date, "sha1:" + base64.b32encode(bytes.fromhex(of_sha1)).decode()), of_url, iso_date(of_date))
            out.append(warc_record({"url": u, "ip": i, "date": d, "mime": m, "body": b}, of)[:-1].decode())
        return pd.Series(out, dtype=object)

    return F.pandas_udf(convert, "string")("url", "ip", "date", "mime", "body", "first")


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files of marked records."""
    records.select(warc_text(records).alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).mode("overwrite").text(path)


_WARC_SCHEMA = "record_type string, record_id string, refers_to_id string, uri string, date string, payload_digest string, page_id string, payload binary"


def read_warc(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """One row per record of the WARC files in a folder; the payload of a revisit is null, page_id is the header X-Page-Id as ``id_type``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parse_warc(unzip(content.as_py())):
                    headers, payload = parse_http(block)
                    revisit = fields["warc-type"] == "revisit"
                    page = headers.get("x-page-id")
                    rows.append(
                        (
                            fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-target-uri"], fields["warc-date"],
                            fields["warc-payload-digest"], None if page is None else unquote(page), None if revisit else payload,
                        )
                    )
                    size += len(block)
                    if size > FILE_BYTES // 4:
                        yield _read_batch(rows)
                        rows, size = [], 0
                yield _read_batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(parse, _WARC_SCHEMA).withColumn("page_id", F.col("page_id").try_cast(id_type))


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 7 + [pa.binary()]
    names = [x.split()[0] for x in _WARC_SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def convert_pages(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages through legacy ARC to WARC files under ``path`` (the shared folder if none is given), read back.

    One row per record: page_id, record_type, payload_bytes, payload_digest (lower-case hex), refers_to (page_id).
    """
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    id_type = pages.schema["page_id"].dataType.simpleString()
    write_warc(mark_revisits(arc_records(pages_to_arc(pages), id_type)), path)
    back = read_warc(spark, path, id_type)
    # A revisit has its length from the response that it names, as a reader of the archive would find it.
    rows = back.select("page_id", "record_type", "record_id", "refers_to_id", "payload_digest", F.octet_length("payload").cast("long").alias("n"))
    responses = rows.filter("record_type = 'response'").groupBy(F.col("record_id").alias("_id")).agg(F.max("page_id").alias("refers_to"), F.max("n").alias("_n"))
    met = rows.join(responses, rows["refers_to_id"] == responses["_id"], "left")
    return met.select("page_id", "record_type", F.coalesce("n", "_n").alias("payload_bytes"), "payload_digest", "refers_to", "record_id")


def hex_digest(digest: Column) -> Column:
    """``sha1:`` base32 as lower-case hex."""

    def decode(batch: pd.Series) -> pd.Series:
        return batch.map(lambda d: base64.b32decode(d[5:]).hex())

    return F.pandas_udf(decode, "string")(digest)
