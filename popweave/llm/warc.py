"""Legacy web archives (ARC versions 1 and 2) converted to WARC 1.1.

``pages_to_arc`` packs pages into ARC files, ``arc_records`` parses ARC bytes
by their version block and declared lengths, ``write_warc`` writes real WARC
files with Spark's text writer (a record ends with CRLF CRLF, which is the
writer's line separator), and ``read_warc`` parses them by Content-Length.
Files go through Spark's readers and writers only, so any store works.

Identifiers, timestamps, types and digests are synthesised from the ARC header:
the record id is a UUID made from URI, date and block digest, the date becomes
ISO 8601, an HTTP response becomes ``response`` (or ``revisit``), anything else
``resource``, and digests are SHA-256.

Defined results
* null html: an empty payload; null url: an empty target; null page_id: read
  back as null, and never chosen before a number when payloads are equal.
* payloads of 100 bytes or more are grouped by digest and length; all rows with
  the group's smallest page_id are responses, the others revisit it.
* repeated rows make a record each, with ids of their own (they follow from the
  ARC file's name and the record's offset too); an empty table makes an empty
  archive; further columns are ignored whatever their names.
* WARC files close at VOLUME_BYTES, so only a record of that size makes a longer one.
* page ids are whole longs; an X-Page-Id that is no long (in a foreign archive) is read
  as null, and so are other numbers of our own headers.
* a record whose declared length goes beyond its file is kept as far as it goes, a WARC
  record without a valid length up to the next one; both are marked ``truncated``. ARC
  header lines that don't parse are skipped. Damaged gzip data is read as far as it
  goes. Readers only ever move forward, so any bytes at all are read to their end.
* a date that is none becomes the first of 1970.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popweave.llm._store import scoped, scratch_path, stored
from popweave.llm._words import slices, utf8

#: Header lines of the two ARC versions (fixed values of the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Payloads below this many bytes are never revisits.
MIN_REVISIT_BYTES = 100
PAGE_HEADER = b"X-Page-Id: "
#: Bytes of records after which a WARC file is closed.
VOLUME_BYTES = 64 << 20
#: A declared length.
LENGTH = re.compile(r"[0-9]{1,18}")


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    truncated: bool
    offset: int


def arc_file(name: str, version: int, date: str, entries: Iterable[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file; entries are (url, content type, result code, block)."""
    about = f"{version} 0 popweave\n{ARC_FIELDS[version]}\n".encode()
    middle = {1: "", 2: "200 - - 0 " + name + " "}[version]
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {middle}{len(about)}\n".encode(), about, b"\n"]
    offset = sum(map(len, out))
    for url, mime, code, block in entries:
        middle = {1: "", 2: f"{code} {hashlib.md5(block).hexdigest()} - {offset} {name} "}[version]
        head = f"{url or '-'} 0.0.0.0 {date} {mime} {middle}{len(block)}\n".encode()
        out += [head, block, b"\n"]
        offset += len(head) + len(block) + 1
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block."""
    names = ARC_FIELDS[1].split()
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].strip().decode("utf-8", "replace")
        at = end + 1
        if not line:
            continue
        if line.startswith("filedesc://"):
            length = line.rpartition(" ")[2]
            size = int(length) if LENGTH.fullmatch(length) else 0
            about = data[at : at + size].decode("latin-1").split("\n")
            if len(about) > 1:
                given = about[1].split()
                own = given if given and given[-1] == "Archive-length" else None
                names = own or ARC_FIELDS[2 if about[0].startswith("2") else 1].split()
            at += size
            continue
        values = line.split(" ")
        if len(values) < len(names) or not LENGTH.fullmatch(values[-1]):
            continue
        # Old writers left spaces in URLs: what is too many belongs to the first field.
        extra = len(values) - len(names)
        values = ["%20".join(values[: extra + 1]), *values[extra + 1 :]]
        size = int(values[-1])
        fields = dict.fromkeys(ARC_FIELDS[1].split(), "-") | dict(zip(names, values, strict=True))
        yield ArcRecord(fields, data[at : at + size], at + size > len(data), at)
        at += size


def iso_date(date: str) -> str:
    """ISO 8601 of an ARC date of 14 digits (12 in old files; missing parts are the first)."""
    digits = re.sub(r"[^0-9]", "", date)[:14]
    digits += "19700101000000"[len(digits) :]
    parts = [int(digits[a:b]) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14))]
    try:
        return f"{datetime(*parts).isoformat()}Z"
    except ValueError:
        return "1970-01-01T00:00:00Z"


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """(head with its blank line, payload) of an HTTP response, else None."""
    if not block.startswith(b"HTTP/"):
        return None
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def page_of(head: bytes) -> int | None:
    at = head.find(b"\r\n" + PAGE_HEADER)
    if at < 0:
        return None
    at += 2 + len(PAGE_HEADER)
    return whole_long(head[at : head.find(b"\r\n", at)].decode("latin-1"))


def whole_long(number: str | None) -> int | None:
    """A number in the range of a long, else None."""
    if number is None or not re.fullmatch(r"-?[0-9]{1,19}", number.strip()):
        return None
    value = int(number)
    return value if -(1 << 63) <= value < 1 << 63 else None


def pages_to_arc(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """(name, data): ARC files of a few MB, versions 1 and 2 in turn."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        n = -1
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                n += 1
                entries = []
                for page, url, html in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), utf8(part.column("html")), strict=True):
                    mark = b"" if page is None else PAGE_HEADER + str(page).encode() + b"\r\n"
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mark + b"\r\n"
                    entries.append((quote(url or "", safe="%/:?#[]@!$&'()*+,;=~"), "text/html", "200", head + html))
                name = f"part-{task:06d}-{n:06d}.arc"
                yield pa.RecordBatch.from_pydict({"name": [name], "data": pa.array([arc_file(name, 1 + n % 2, date, entries)], pa.binary())})

    return pages.select("page_id", "url", "html").mapInArrow(pack, "name string, data binary")


RECORDS = "page_id long, record_id string, uri string, date string, ip string, kind string, mime string, head binary, payload binary, payload_bytes long, payload_digest string, block_digest string, truncated boolean"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def arc_records(arcs: DataFrame, column: str = "data") -> DataFrame:
    """What each ARC record needs to become a WARC record (of files with a name, if there is such a column)."""
    names = [f.name for f in T._parse_datatype_string(RECORDS)]
    schema = _arrow(RECORDS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, file in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = []
                for r in parse_arc(data.as_py() or b""):
                    f, http = r.fields, split_http(r.block)
                    head, payload = http or (b"", r.block)
                    block = hashlib.sha256(r.block).hexdigest()
                    key = f"{file}|{r.offset}|{f['URL']}|{f['Archive-date']}|{block}"
                    rows.append((page_of(head), f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>", f["URL"], iso_date(f["Archive-date"]), f["IP-address"], "response" if http else "resource", f["Content-type"], head, payload, len(payload), hashlib.sha256(payload).hexdigest(), block, r.truncated))
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema=schema)

    return arcs.select(column, F.col("name") if "name" in arcs.columns else F.lit("").alias("name")).mapInArrow(parse, RECORDS)


def with_revisits(records: DataFrame) -> DataFrame:
    """Adds refers_id and refers_page to all but the first of equal payloads.

    Records must be a stored table. Only (digest, id) rows are shuffled by
    digest, and summed before that; payloads are joined by page, which has no
    large groups.
    """
    small = records.where((F.col("payload_bytes") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull() & (F.col("kind") == "response"))
    key = ["payload_digest", "payload_bytes"]
    first = small.groupBy(*key).agg(F.min(F.struct("page_id", "record_id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = small.select("page_id", "record_id", *key).join(first, key).where("page_id > first.page_id")
    later = later.select("page_id", F.col("first.page_id").alias("refers_page"), F.col("first.record_id").alias("refers_id"), "payload_digest").distinct()
    return records.join(later, ["page_id", "payload_digest"], "left")


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))).otherwise("")


def warc_text(revisit: Column) -> Column:
    """The whole WARC record, without the CRLF CRLF after it."""
    block = F.when(revisit, F.col("head")).otherwise(F.concat(F.col("head"), F.col("payload")))
    http = F.col("kind") == "response"
    lines = [
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("kind"))),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-IP-Address", F.col("ip")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Block-Digest", F.when(~revisit, F.concat(F.lit("sha256:"), F.col("block_digest")))),
        _line("WARC-Truncated", F.when(F.col("truncated"), "unspecified")),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(revisit, F.col("refers_id"))),
        _line("X-Refers-To-Page-Id", F.when(revisit, F.col("refers_page"))),
        _line("X-Payload-Length", F.col("payload_bytes")),
        _line("Content-Type", F.when(http, "application/http; msgtype=response").otherwise(F.col("mime"))),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block.cast("string"),
    ]
    return F.concat(*lines)


def write_warc(records: DataFrame, path: str, volume_bytes: int = VOLUME_BYTES) -> None:
    """Gzipped WARC files under ``path`` (kind response with refers_id: revisit), of about ``volume_bytes`` each."""

    def volumes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            size = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(((ends - size) // volume_bytes).astype(np.int32))], ["value", "volume"])
            before = int(ends[-1]) if len(ends) else before

    text = records.select(warc_text(F.col("refers_id").isNotNull()).alias("value")).mapInArrow(volumes, "value string, volume int")
    text.write.partitionBy("volume").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers, block, whether it is cut short) of each record, by Content-Length."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4
        told = headers.get("content-length", "")
        if LENGTH.fullmatch(told):
            to = at + int(told)
        else:
            to = data.find(b"\r\n\r\nWARC/1.", end)
            to = len(data) if to < 0 else max(to, at)
        yield headers, data[at:to], to > len(data) or not LENGTH.fullmatch(told)
        at = to


def unzipped(data: bytes) -> bytes:
    """All members of gzip data, as far as they are sound; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    member = zlib.decompressobj(31)
    for at in range(0, len(data), 1 << 20):
        piece = data[at : at + (1 << 20)]
        try:
            while piece:
                out.append(member.decompress(piece))
                piece = member.unused_data
                if member.eof:
                    member = zlib.decompressobj(31)
                else:
                    break
        except zlib.error:
            break
    return b"".join(out)


READ = "page_id long, record_id string, record_type string, uri string, date string, payload_bytes long, payload_digest string, refers_to long, intact boolean, truncated boolean"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record in the WARC files under ``path``.

    Of a revisit, digest and length of the full payload come from its header;
    ``intact`` says whether a response's payload matches its digest.
    """
    names = [f.name for f in T._parse_datatype_string(READ)]
    schema = _arrow(READ)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block, cut in parse_warc(unzipped(content.as_py())):
                    head, payload = split_http(block) or (b"", block)
                    told = h.get("warc-payload-digest", "").rpartition(":")[2]
                    kind = h.get("warc-type", "")
                    if kind == "revisit":
                        size, digest, intact = whole_long(h.get("x-payload-length")) or 0, told, None
                    else:
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        intact = digest == told
                    refers = whole_long(h.get("x-refers-to-page-id"))
                    rows.append((page_of(head), h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), size, digest, refers, intact, cut))
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(parse, READ)


@scoped
def convert_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages to ARC to WARC files under ``path``, then read back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    records = stored(arc_records(pages_to_arc(pages)), "records")
    write_warc(with_revisits(records), path)
    return read_warc(spark, path)


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, payload_digest,
         min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN first_page END AS refers_to
FROM g
"""
