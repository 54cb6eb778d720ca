import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.warc import archive_round_trip, assemble, base32_sha1, read_warc

SCHEMA = "page_id long, url string, html string, response string, type string"


def payload(html):
    data = (html or "").encode()
    return len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()


def captures(df):
    fields = F.col("metadata.fields")
    return df.select(
        fields["pageId"].cast("long").alias("page_id"), F.when(F.col("response.type") == "revisit", fields["payloadLength"].cast("long"))
        .otherwise(F.col("response.payload_bytes")).alias("n"), "response.payload_digest", "response.type",
        fields["revisitOf"].cast("long").alias("of"), "response.payload", "response.verified", "request.record_id", "response.target_uri",
    ).collect()


def test_round_trip(spark, folder):
    random.seed(2)
    html = ["<p>é</p>", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nx", "", None, "\n", "z" * 300_000, "<p>é</p>"] + [f"<p>{random.randint(0, 9)}</p>" for _ in range(60)]
    pages = [(i, f"http://h{i}.example/x?q={i}#f", h) for i, h in enumerate(html, start=-2)]
    found = captures(archive_round_trip(spark.createDataFrame([(*p, "r", "t") for p in pages], SCHEMA).repartition(4), folder("warc")))
    first = {}
    for i, _, h in sorted(pages, key=lambda p: p[0]):
        first.setdefault(payload(h), i)
    wanted = {i: (*payload(h), "response" if first[payload(h)] == i else "revisit", None if first[payload(h)] == i else first[payload(h)]) for i, _, h in pages}
    assert len(found) == len(pages)
    assert {r.page_id: (r.n, r.payload_digest, r.type, r.of) for r in found} == wanted
    bodies = dict((i, (h or "").encode()) for i, _, h in pages)
    assert all(bytes(r.payload) == bodies[r.page_id] and r.verified for r in found if r.type == "response")
    assert all(r.record_id for r in found)


def test_odd_pages(spark, folder):
    rows = [(1, None, None), (None, "http://x/\r\nWARC-Type: request", "a"), (2, "no scheme", "a"), (3, "http://y/", "b"), (3, "http://y/", "b"), (None, None, None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    found = captures(archive_round_trip(df, folder("warc")))
    kinds = sorted((str(r.page_id), r.type, str(r.of)) for r in found)
    assert kinds == [("1", "response", "None"), ("2", "response", "None"), ("3", "response", "None"), ("3", "revisit", "3"),
                     ("None", "revisit", "1"), ("None", "revisit", "2")]
    assert {r.target_uri for r in found if r.of == 2} == {"http://x/WARC-Type:request"}


def test_small_payloads_are_all_responses(spark, folder):
    df = spark.createDataFrame([(i, "http://x/", h, "", "") for i, h in enumerate(["a", "a", "long enough", "long enough"])], SCHEMA)
    assert sorted((r.page_id, r.type) for r in captures(archive_round_trip(df, folder("warc"), min_bytes=5))) == [
        (0, "response"), (1, "response"), (2, "response"), (3, "revisit")]


def test_no_pages(spark, folder):
    assert captures(archive_round_trip(spark.createDataFrame([], SCHEMA), folder("warc"))) == []


def test_reads_other_archives(spark, tmp_path):
    def record(kind, name, extra, block):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n{extra}Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    http = "Content-Type: application/http; msgtype=response\r\n"
    parts = [record("warcinfo", "<i>", "", b"software: x\r\n"), record("response", "<r>", http, b"HTTP/1.0 200 OK\r\n\r\nbody\r\n\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "b.warc").write_bytes(record("response", "<s>", http, b"HTTP/1.0 204 No Content\r\n\r\n"))
    rows = read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.type, r.record_id, bytes(r.payload)) for r in rows) == [
        ("response", "<r>", b"body\r\n\r\n"), ("response", "<s>", b""), ("warcinfo", "<i>", b"software: x\r\n")]
    lone = assemble(read_warc(spark, str(tmp_path)))
    assert sorted((r.capture_id, r.request, r.metadata) for r in lone.collect()) == [("<r>", None, None), ("<s>", None, None)]
    (tmp_path / "c.warc").write_bytes(parts[1][:-12])
    with pytest.raises(Exception, match="cut short"):
        read_warc(spark, str(tmp_path / "c.warc")).collect()


def test_base32(spark):
    texts = ["", "a", "é" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(base32_sha1(F.col("t"))).collect()
    assert [r[0] for r in got] == [payload(t)[1] for t in texts]


def test_empty_ids_are_not_missing_ones(spark, folder):
    pages = spark.createDataFrame([("", "u", "same"), (None, "u", "same"), ("b", "u", "same")], "page_id string, url string, html string")
    captures = archive_round_trip(pages, folder("warc")).select("response.type").collect()
    assert sorted(r[0] for r in captures) == ["response", "revisit", "revisit"]


def test_repeated_pages_spread_over_files(spark, folder, monkeypatch):
    from tidemark.llm import warc

    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    pages = spark.range(2000).selectExpr("CAST(NULL AS long) AS page_id", "'http://a.org/' AS url", "repeat('x', 200) AS html")
    path = folder("warc")
    assert archive_round_trip(pages, path).groupBy("response.type").count().collect() and spark.read.format("binaryFile").load(path).count() >= 8
    sizes = [r[0] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert max(sizes) < 4 * sum(sizes) / len(sizes)
