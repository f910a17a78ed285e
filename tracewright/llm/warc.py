"""WARC derivatives: each response gives a metadata record and a plain-text conversion record that refer to it.

A record is a row ``record_id, type, target_uri, date, refers_to, concurrent_to, content_type,
block_digest, payload_digest, headers (the other named fields, and repeated ones), block``. ``responses`` makes records of
fetched pages, ``read`` of WARC files (plain or gzip, record by record); ``derive`` makes the derivatives, and
``serialise`` the bytes of a record.

A derivative keeps the source's target URI and date, and refers to its record id. The metadata record
lists the source's payload and block digests, its links and other WARC header fields (``source-``), HTTP status and HTTP
header fields as ``warc-fields``, with the length and digest of the text; it is concurrent to the conversion record. The conversion's block is the visible text (``html.render``) of an
HTML payload, or a plain-text payload as it is, in UTF-8. Digests are SHA-1 in base 32. Ids are name-based
UUIDs of source id and kind, so a task that runs again makes the same records.

Defined cases: a null payload is an empty one; a null URI gives records without one; responses of other media types
get metadata alone; records of other types give nothing; chunked and gzip or deflate bodies are decoded, and taken as they are
where that fails; payloads in an unknown or wrong charset are read as UTF-8 with replacements; repeated rows give
repeated records; an empty table gives an empty table; only the named columns are read, so other columns can't clash. Of a file, what comes after a record cut short, or after
a broken gzip member, is left out; a record without a length that is a number is left out alone. A file is read as a whole, so it
may have 2 GB at most.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .html import render

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, RFC 4122
FIELDS = "record_id string, type string, target_uri string, date string, refers_to string, concurrent_to string, content_type string, block_digest string, payload_digest string, headers array<struct<name:string,value:string>>, block binary"
NAMED = {"WARC-Record-ID": "record_id", "WARC-Type": "type", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Refers-To": "refers_to", "WARC-Concurrent-To": "concurrent_to", "Content-Type": "content_type", "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest"}
_BY_NAME = {k.lower(): v for k, v in NAMED.items()}
_KIND = pa.schema([(n, pa.string()) for n in NAMED.values()] + [("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary())])
FETCHED = "2024-01-01T00:00:00Z"
#: Records an output batch holds at most.
ROWS = 256


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def name(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(10).join(parts))}>"


def record(kind: str, rid: str, block: bytes, content_type: str, **more) -> dict:
    return {"refers_to": None, "concurrent_to": None, "target_uri": None, "date": None, "payload_digest": None, "headers": []} | more | {"record_id": rid, "type": kind, "content_type": content_type, "block": block, "block_digest": digest(block)}


def fields_of(named: list[tuple[str, str | None]]) -> list[dict]:
    """Header fields in order; those without a value are left out."""
    return [{"name": k, "value": v} for k, v in named if v is not None]


def response(page: str, uri: str | None, payload: bytes, date: str = FETCHED) -> dict:
    """The record of a fetched HTML page."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    of = digest(payload)
    return record("response", name("response", page, uri or "", of), head + payload, "application/http; msgtype=response", target_uri=uri, date=date, payload_digest=of)


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields and raw body of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, body = block.partition(b"\n\n")
    lines = head.decode("latin-1").replace("\r\n", "\n").split("\n")
    fields = [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in lines[1:]) if c]
    return lines[0], fields, body


def entity(fields: dict[str, str], body: bytes) -> bytes:
    """The body without transfer and content codings."""
    try:
        if "chunked" in fields.get("transfer-encoding", "").lower():
            out, at = [], 0
            while True:
                end = body.index(b"\r\n", at)
                size = int(body[at:end].split(b";")[0], 16)
                if not size:
                    break
                out.append(body[end + 2 : end + 2 + size])
                at = end + 4 + size
            body = b"".join(out)
        coding = fields.get("content-encoding", "").lower()
        if coding in ("gzip", "x-gzip"):
            return gzip.decompress(body)
        if coding == "deflate":
            return zlib.decompress(body)
    except (ValueError, OSError, EOFError, zlib.error):
        pass
    return body


def derivatives(source: dict) -> list[dict]:
    """The metadata record of a response, and its conversion record if its payload is text."""
    status, fields, body = http(source["block"])
    by = {k.lower(): v for k, v in fields}
    media = by.get("content-type", "")
    kind = media.split(";")[0].strip().lower()
    rid, uri, date = source["record_id"], source["target_uri"], source["date"]
    payload = source["payload_digest"] or digest(body)
    shared = {"refers_to": rid, "target_uri": uri, "date": date}
    kept = [("source-payload-digest", payload), ("source-block-digest", source["block_digest"]), ("source-WARC-Refers-To", source["refers_to"]), ("source-WARC-Concurrent-To", source["concurrent_to"])]
    others = [(h["name"], h["value"]) for h in source["headers"] or ()]
    kept += [(f"source-{k}", v) for k, v in others]
    listed = [(k, v) for k, v in kept if v is not None] + [("http-status", status)] + [(f"http-{k}", v) for k, v in fields]
    out, conversion = [], None
    if kind in ("text/html", "application/xhtml+xml", "text/plain"):
        charset = re.search(r"charset=\"?([\w.:-]+)", media, re.I)
        raw = entity(by, body)
        try:
            text = raw.decode(charset[1] if charset else "utf-8", "replace")
        except (LookupError, ValueError):
            # Unknown, or one that can't replace what it can't read.
            text = raw.decode("utf-8", "replace")
        plain = (text if kind == "text/plain" else render(text)).encode("utf-8", "replace")
        conversion = name("conversion", rid)
        out.append(record("conversion", conversion, plain, "text/plain; charset=utf-8", headers=fields_of([("X-Source-Payload-Digest", payload), ("X-Source-Block-Digest", source["block_digest"]), *((f"X-Source-{k}", v) for k, v in others)]), payload_digest=digest(plain), **shared))
        listed += [("text-length", str(len(plain))), ("text-digest", out[0]["block_digest"])]
    fields_block = "".join(f"{k}: {v}\r\n" for k, v in listed).encode()
    return [record("metadata", name("metadata", rid), fields_block, "application/warc-fields", concurrent_to=conversion, **shared), *out]


def to_bytes(r: dict) -> bytes:
    """A record as WARC/1.1."""
    named = [(k, r[v]) for k, v in NAMED.items() if r.get(v) is not None] + [(h["name"], h["value"]) for h in r["headers"] or ()]
    head = "".join(f"{k}: {v}\r\n" for k, v in named)
    return f"WARC/1.1\r\n{head}Content-Length: {len(r['block'])}\r\n\r\n".encode() + r["block"] + b"\r\n\r\n"


def parse(stream) -> Iterator[dict]:
    """Records of an uncompressed WARC stream; a truncated last record is left out."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        out, more, length = dict.fromkeys(NAMED.values()), [], 0
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            k, v = k.strip(), v.strip()
            if k.lower() == "content-length":
                length = int(v) if re.fullmatch("[0-9]{1,18}", v) else -1
            elif out.get(_BY_NAME.get(k.lower(), ""), v) is None:
                out[_BY_NAME[k.lower()]] = v
            else:
                more.append((k, v))
        if length < 0:
            continue
        block = stream.read(length)
        if len(block) < length:
            return
        yield out | {"headers": fields_of(more), "block": block}


class Inflated(io.RawIOBase):
    """The content of gzip members one after the other, up to where they are broken."""

    PIECE = 1 << 16

    def __init__(self, raw: bytes):
        self.raw, self.at, self.piece, self.member = raw, 0, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        out = b""
        while not out and self.member is not None:
            if self.member.eof:
                # The next member begins where this one left off.
                self.at -= len(self.member.unused_data)
                self.piece, more = b"", self.raw[self.at : self.at + 2] == b"\x1f\x8b"
                self.member = zlib.decompressobj(31) if more else None
                continue
            if not self.piece:
                self.piece = self.raw[self.at : self.at + self.PIECE]
                self.at += len(self.piece)
            last = not self.piece
            try:
                out = self.member.decompress(self.piece, len(into))
            except zlib.error:
                last = True
            self.piece = self.member.unconsumed_tail
            if last and not out and not self.member.eof:
                self.member = None
        into[: len(out)] = out
        return len(out)


def records_of(raw: bytes) -> Iterator[dict]:
    """Records of a file's bytes, plain or gzip, up to where it is broken."""
    yield from parse(io.BufferedReader(Inflated(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw))


def _batches(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    size = 0
    for r in records:
        rows.append(r)
        size += len(r["block"])
        if len(rows) >= ROWS or size > 16 << 20:
            yield pa.RecordBatch.from_pylist(rows, _KIND)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _KIND)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = FETCHED) -> DataFrame:
    """Response records of fetched pages."""
    common.small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("string"), F.col(url_col).cast("string"), F.col(html_col).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(response(i or "", u, h or b"", date) for b in batches for i, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True))

    return rows.mapInArrow(run, FIELDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``; a file is one task's, read by Spark's own file reader."""
    common.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                yield from _batches(records_of(raw))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, FIELDS)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the responses among ``records``."""
    common.small_batches(records.sparkSession)
    rows = records.where("type = 'response'").select("record_id", "target_uri", "date", "refers_to", "concurrent_to", "payload_digest", "block_digest", "headers", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(d for b in batches for r in b.to_pylist() for d in derivatives(r))

    return rows.mapInArrow(run, FIELDS)


def serialise(records: DataFrame) -> DataFrame:
    """``record_id, bytes``: each record as a gzip member, ready to be concatenated into a ``.warc.gz``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["record_id"] for r in rows], pa.string()), pa.array([gzip.compress(to_bytes(r), mtime=0) for r in rows], pa.binary())], ["record_id", "bytes"])

    return records.mapInArrow(run, "record_id string, bytes binary")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Derivatives of all pages: their fields, and the length and digest of their blocks."""
    found = derive(responses(common.table(spark, sf_dir, "pages")))
    return found.select("record_id", "type", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "block_digest", "payload_digest", F.length("block").cast("long").alias("content_length"))
