"""Legacy web archives: ARC files parsed by version and declared length, converted to WARC, and read back.

An ARC file opens with a version block whose second line names the fields of every later header line; version 1
has five fields, version 2 has ten. A record is its header line and as many bytes as the line's last field says.
The converter gives each record an identifier, a timestamp, a type and digests, as a WARC record; a record whose
payload another record already holds becomes a revisit of it, with the HTTP headers alone.

Defined cases: a null payload is empty; a null url is written as "unknown:"; white space in a url is escaped; a
null page_id ranks after all others and is never referred to while another id has the payload; rows that repeat
the smallest page_id of a payload are each a response; empty tables give no archives. Only page_id, url and
html are read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_left_join, small_batches, staged

#: Fixed values of the format: the header fields of each version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
ARCHIVE_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def arc_opening(name: str, date: str, version: int = 1) -> bytes:
    body = f"{version} 0 spindrift\n{' '.join(ARC_FIELDS[version])}\n".encode()
    last = f"{len(body)}" if version == 1 else f"200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {last}\n".encode() + body + b"\n"


def arc_record(url: str, date: str, kind: str, block: bytes, version: int = 1, ip: str = "0.0.0.0", code: int = 200, offset: int = 0, name: str = "-") -> bytes:
    last = f"{len(block)}" if version == 1 else f"{code} - - {offset} {name} {len(block)}"
    return f"{url} {ip} {date} {kind} {last}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and the block of each record after the version block; ValueError where a length is wrong."""
    fields, at = None, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at {at} does not end")
        if end == at:  # blank lines between records
            at += 1
            continue
        values = data[at:end].decode("utf-8", "replace").split(" ")
        length, start = int(values[-1]), end + 1
        if length < 0 or start + length > len(data):
            raise ValueError(f"record at {at} declares {length} bytes")
        block = data[start : start + length]
        if fields is None:
            if not values[0].startswith("filedesc://"):
                raise ValueError("no version block")
            version = int(block.split(b" ", 1)[0])
            fields = ARC_FIELDS[version]
            named = block.split(b"\n")[1].decode().split(" ")
            if named != fields:
                raise ValueError(f"version {version} has other fields: {named}")
        else:
            if len(values) != len(fields):
                raise ValueError(f"header line at {at} has {len(values)} fields of {len(fields)}")
            yield dict(zip(fields, values)), block
        at = start + length


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload."""
    end = block.find(b"\r\n\r\n")
    return (b"", block) if end < 0 or not block.startswith(b"HTTP/") else (block[: end + 4], block[end + 4 :])


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, date: str, page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page}')}>"


def iso(date: str) -> str:
    """14 digits (missing ones as in 1 January, midnight) as a WARC date."""
    d = date[:14] + "00000101000000"[len(date[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def convert(fields: dict[str, str], block: bytes, page: str = "", revisits: tuple[str, str] | None = None) -> bytes:
    """One ARC record as a WARC record. revisits: page and record id of the response that has the payload."""
    url, date = fields["URL"], fields["Archive-date"]
    head, payload = http_parts(block)
    name = f"page:{page}" if page else url  # revisits know the page of the response, but not its url
    out = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", record_id(name, date, page)), ("WARC-Date", iso(date)), ("WARC-Target-URI", url)]
    out += [("WARC-IP-Address", fields["IP-address"])] * (fields["IP-address"] not in ("", "-"))
    out += [("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if revisits:
        out += [("WARC-Profile", PROFILE), ("WARC-Refers-To", revisits[1]), ("X-Refers-To-Page", revisits[0])]
        block = head
    out += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response" if head else fields["Content-type"])]
    return warc_record(out, block)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start, length = end + 4, int(headers["Content-Length"])
        block = data[start : start + length]
        if len(block) < length or data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} declares {length} bytes")
        yield headers, block
        at = start + length + 4


def _page(url, page, html, date):
    """The HTTP message a crawler would have stored."""
    payload = (html or "").encode()
    ident = "" if page is None else f"X-Page-Id: {page}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{ident}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def write_archives(pages: DataFrame, date: str = "20240101000000", version: int = 1, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Table of WARC archives (one binary value each, about archive_bytes), in the shared folder.

    Each page is put in an ARC archive as it came; the archive is parsed again and converted. Which record holds
    a payload first is one partial aggregate over digests; only digests that repeat are looked up, salted."""
    small_batches(pages.sparkSession)
    p = pages.select("page_id", "url", "html").withColumn("sha", F.unhex(F.sha1(F.coalesce("html", F.lit("")))))
    long_enough = F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes
    first = p.where(long_enough).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("sha", "first")
    p = salted_left_join(p, first, "sha", ["page_id", "url"]).select("page_id", "url", "html", "first")

    def run(batches):
        def archive(rows):
            name = f"part-{rows[0][0]}.arc"
            blob = bytearray(arc_opening(name, date, version))
            for page, url, html, _ in rows:
                kind, block = "text/html", _page(url, page, html, date)
                blob += arc_record(quote(url or "unknown:", safe=":/?#[]@!$&'()*+,;=%-._~") or "unknown:", date, kind, block, version, offset=len(blob), name=name)
            out = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, date, "")), ("WARC-Date", iso(date)), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n")]
            for (page, _, _, first), (fields, block) in zip(rows, parse_arc(bytes(blob)), strict=True):
                again = first is not None and (page is None or page > first)
                out.append(convert(fields, block, "" if page is None else str(page), (str(first), record_id(f"page:{first}", date, str(first))) if again else None))
            return b"".join(out)

        held, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                size += len(row[2] or "")
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held)], "binary")], ["warc"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)], "binary")], ["warc"])

    return staged(p.mapInArrow(run, "warc binary"), "warc")


def read_archives(archives: DataFrame, page_type: str = "bigint") -> DataFrame:
    """A row per response or revisit record: what its headers say, checked against its block where it has one."""
    small_batches(archives.sparkSession)
    number = re.compile(rb"\r\nContent-Length: (\d+)\r\n")
    ident = re.compile(rb"\r\nX-Page-Id: (-?\d+)\r\n")
    kinds = {"page_id": page_type, "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": page_type, "target_uri": "string", "record_id": "string", "warc_date": "string"}
    types = [pa.int32() if k == "int" else pa.int64() if k != "string" else pa.string() for k in kinds.values()]

    def run(batches):
        for b in batches:
            for blob in b.column(0):
                rows = []
                for h, block in parse_warc(blob.as_py()):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    head, payload = http_parts(block)
                    own, size, page = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(number.search(head)[1]), ident.search(head)
                    if h["WARC-Type"] == "response" and (digest(payload), len(payload)) != (own, size):
                        raise ValueError(f"{h['WARC-Record-ID']}: the payload isn't what its headers say")
                    ref = h.get("X-Refers-To-Page")
                    rows.append((int(page[1]) if page else None, size, own, h["WARC-Type"], int(ref) if ref else None, h["WARC-Target-URI"], h["WARC-Record-ID"], h["WARC-Date"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], list(kinds))

    return archives.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def query(pages: DataFrame) -> DataFrame:
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_archives(write_archives(pages), kind)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first, sha1(html) AS h FROM p GROUP BY html),
d AS (
  SELECT html, first, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((((instr('0123456789abcdef', substr(h, i * 5 // 4 + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, i * 5 // 4 + 2, 1)) - 1) >> (3 - i * 5 % 4)) & 31) + 1, 1)), 'string_agg', '') AS digest
  FROM f)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN p.page_id > d.first OR (p.page_id IS NULL AND d.first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > d.first OR (p.page_id IS NULL AND d.first IS NOT NULL) THEN d.first END AS refers_to
FROM p JOIN d USING (html)
"""
