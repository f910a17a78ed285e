"""WARC records: round trips, links, digests, odd responses."""

import base64
import gzip
import hashlib
import io

import brute
from brute import SF
from pyspark.sql import functions as F

from tracewright.llm import html, warc


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derivatives_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    sources = {r.record_id: r for r in warc.responses(pages).collect()}
    by_url = {}
    for p in pages.collect():
        by_url.setdefault(p.url, set()).add(html.render(p.html))
    found = warc.derive(warc.responses(pages)).collect()
    assert len(found) == 2 * len(sources)
    conversions = {r.record_id: r for r in found if r.type == "conversion"}
    for r in found:
        source = sources[r.refers_to]
        assert (r.target_uri, r.date) == (source.target_uri, source.date)
        assert r.block_digest == sha1(bytes(r.block))
        if r.type == "conversion":
            assert bytes(r.block).decode() in by_url[r.target_uri]
        else:
            fields = dict(x.split(": ", 1) for x in bytes(r.block).decode().split("\r\n") if x)
            assert fields["source-payload-digest"] == source.payload_digest and fields["http-Content-Type"].startswith("text/html")
            assert fields["text-digest"] == conversions[r.concurrent_to].block_digest


def test_round_trip_through_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x"), (2, None, None)], "page_id long, url string, html string")
    records = warc.responses(pages).unionByName(warc.derive(warc.responses(pages)))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(bytes(r.bytes) for r in warc.serialise(records).collect()))
    key = lambda r: (r.record_id, r.type, r.target_uri, r.refers_to, r.block_digest, bytes(r.block), [tuple(h) for h in r.headers])
    assert sorted(map(str, map(key, warc.read(spark, str(tmp_path)).collect()))) == sorted(map(str, map(key, records.collect())))
    assert warc.derive(warc.read(spark, str(tmp_path))).count() == 4


def test_codings_and_other_media():
    body = gzip.compress(b"<p>hi")
    chunked = b"3\r\n" + body[:3] + b"\r\n" + f"{len(body) - 3:x}".encode() + b"\r\n" + body[3:] + b"\r\n0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunked
    source = warc.record("response", "<urn:uuid:1>", block, "application/http")
    assert warc.derivatives(source)[1]["block"] == b"hi"
    broken = warc.record("response", "<urn:uuid:2>", block.replace(b"3\r\n", b"zz\r\n", 1), "application/http")
    assert len(warc.derivatives(broken)) == 2
    image = warc.record("response", "<urn:uuid:3>", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89", "application/http")
    assert [d["type"] for d in warc.derivatives(image)] == ["metadata"]
    odd = warc.record("response", "<urn:uuid:4>", b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=nope\r\n\r\n\xff", "application/http")
    assert warc.derivatives(odd)[1]["block"] == "�".encode()
    assert list(warc.parse(io.BytesIO(warc.to_bytes(source)[:-20]))) == []


def test_derivatives_keep_the_source_headers(spark, tmp_path):
    more = {"WARC-IP-Address": "192.0.2.7", "WARC-Warcinfo-ID": "<urn:uuid:9>", "WARC-Truncated": "length"}
    source = warc.response("1", "http://a/", b"<p>x") | {"headers": warc.fields_of(list(more.items())), "concurrent_to": "<urn:uuid:8>"}
    (tmp_path / "a.warc").write_bytes(warc.to_bytes(source))
    found = {r.type: r for r in warc.derive(warc.read(spark, str(tmp_path))).collect()}
    fields = dict(x.split(": ", 1) for x in bytes(found["metadata"].block).decode().split("\r\n") if x)
    assert {k: fields[f"source-{k}"] for k in more} == more
    assert (fields["source-block-digest"], fields["source-payload-digest"], fields["source-WARC-Concurrent-To"]) == (source["block_digest"], source["payload_digest"], "<urn:uuid:8>")
    conversion = {h.name: h.value for h in found["conversion"].headers}
    assert {k: conversion[f"X-Source-{k}"] for k in more} == more and conversion["X-Source-Block-Digest"] == source["block_digest"]


def test_records_equal_the_plain_reader(spark):
    """Serialised records, read by a reader of its own that splits at header ends and lengths."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(40)
    records = warc.responses(pages).unionByName(warc.derive(warc.responses(pages))).collect()
    data = b"".join(warc.to_bytes(r.asDict(recursive=True)) for r in records)
    want = brute.warc_records(data)
    got = list(warc.records_of(data))
    assert len(got) == len(want) == len(records)
    for g, (head, block) in zip(got, want, strict=True):
        named = [(k, g[v]) for k, v in warc.NAMED.items() if g[v] is not None] + [(h["name"], h["value"]) for h in g["headers"]]
        assert sorted([*named, ("Content-Length", str(len(block)))]) == sorted(head) and g["block"] == block


def test_repeated_fields_and_broken_files(spark, tmp_path):
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%d>\r\nWARC-Concurrent-To: <urn:uuid:7>\r\nwarc-concurrent-to: <urn:uuid:8>\r\n"
    good = head % 1 + b"Content-Length: 2\r\n\r\nab\r\n\r\n"
    bad = head % 2 + b"Content-Length: two\r\n\r\nab\r\n\r\n"
    found = list(warc.records_of(good + bad + good))
    assert [r["record_id"] for r in found] == ["<urn:uuid:1>"] * 2
    assert found[0]["concurrent_to"] == "<urn:uuid:7>" and found[0]["headers"] == [{"name": "warc-concurrent-to", "value": "<urn:uuid:8>"}]
    packed = gzip.compress(good) + gzip.compress(good * 50)
    assert len(list(warc.records_of(packed))) == 51
    for cut in (packed[:-9], packed[:-30], gzip.compress(good)[:12], b"\x1f\x8bnothing", gzip.compress(good) + b"tail"):
        assert len(list(warc.records_of(cut))) <= 51
    (tmp_path / "a.warc.gz").write_bytes(packed[:-9])
    assert {r.record_id for r in warc.read(spark, str(tmp_path)).collect()} == {"<urn:uuid:1>"}


def test_any_charset_and_odd_rows(spark):
    for charset in ("idna", "undefined", "hex", "rot13", "utf-7", "utf-16", "punycode", "unicode_escape", "x" * 300, "latin-1"):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n".encode() + b"<p>x\xff\x80y \\u12"
        assert len(warc.derivatives(warc.record("response", "<urn:uuid:4>", block, "application/http"))) == 2
    pages = spark.createDataFrame([(None, None, None), (1, "u", "<p>a"), (1, "u", "<p>a"), (2, "u", "x " * 200_000)], "page_id long, url string, html string").withColumns({"block": F.lit(1), "type": F.lit("x")})
    found = warc.derive(warc.responses(pages)).collect()
    assert len(found) == 8 and len({r.record_id for r in found}) == 6
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0
