"""Web archives: captures written as WARC records, read back, and assembled into one row per capture."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.digest_tree import tree_merge
from tidemark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the WARC 1.1 format and of base32.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"
RECORD_END = "\r\n\r\n"

FILE_BYTES = 16 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
RECORDS = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string,"
    " content_type string, payload_bytes long, payload_digest string, verified boolean, fields map<string,string>, payload binary"
)


def base32_sha1(value: Column) -> Column:
    """SHA-1 of a text in UTF-8, in base32: every five hexadecimal digits are four base32 digits."""
    hexadecimal = F.sha1(value)
    digits = []
    for i in range(8):
        bits = F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*digits)


def _urn(kind: str, *parts: Column) -> Column:
    """A record id that follows from its parts alone, so that a repeated task writes the same one."""
    digest = F.md5(F.concat_ws(":", F.lit(kind), *parts))
    cut = [F.substring(digest, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the two line ends that close it; headers whose value is null are left out."""
    lines = [F.lit(VERSION + EOL)]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit("")))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL)))
    return F.concat(*lines, block)


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes a request, a response or revisit, and a metadata record per page to gzip files below ``path``.

    Of pages whose payloads are equal and have at least ``min_bytes`` bytes, the one with the smallest id
    is the response and the others are revisits of it; a null id is larger than any other (and not the empty one), and of
    rows equal in id and payload one is the response. Shorter payloads are all responses. Null payloads are
    empty, null urls are written as an empty target. Only digests are compared; the payloads move once,
    to about ``FILE_BYTES`` per file, whatever the ids. Lines in urls cannot break the headers: control characters go.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    page = cut_lineage(pages.select(
        F.col(id_col).alias("page_id"), F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("id_text"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7F]+", "").alias("url"),
        html.alias("html"), base32_sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("seq"),
    ), "zstd")
    members = page.select("digest", "n_bytes", F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "seq").alias("me"))
    files = max(1, -(-(members.agg(F.sum("n_bytes")).first()[0] or 0) // FILE_BYTES))
    first = tree_merge(members, ["digest", "n_bytes"], "me").select(
        F.col("me.seq").alias("seq"), F.col("first.page_id").alias("first_id"), (F.col("me.seq") == F.col("first.seq")).alias("is_first"),
    )
    # rows are dealt by their number, so repeated pages, or pages without an id, spread over all files
    placed = page.repartition(files, "seq").join(first.hint("merge"), "seq")
    single = F.col("n_bytes") < min_bytes
    placed = placed.withColumn("revisit", ~single & ~F.col("is_first"))
    first_urn = _urn("response", F.col("digest"))
    own_urn = _urn("capture", F.col("id_text"), F.col("digest"), F.col("seq").cast("string"))
    placed = placed.withColumn("urn", F.when(single | F.col("revisit"), own_urn).otherwise(first_urn))

    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))]
    status = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(EOL + EOL),
    )
    host = F.regexp_extract("url", "^[^:/?#]*://([^/?#]*)", 1)
    target = F.regexp_extract("url", "^[^:/?#]*://[^/?#]*([^#]*)", 1)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn("request", F.col("urn"))), ("WARC-Concurrent-To", F.col("urn")), *common,
         ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(EOL + EOL)),
    )
    capture = _record(
        [("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", F.col("urn")), *common,
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         ("WARC-Refers-To", F.when(F.col("revisit"), first_urn)), ("WARC-Profile", F.when(F.col("revisit"), REVISIT_PROFILE)),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(status, F.when(F.col("revisit"), "").otherwise(F.col("html"))),
    )
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL)), F.lit(""))
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn("metadata", F.col("urn"))), ("WARC-Concurrent-To", F.col("urn")), *common,
         ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(field("pageId", F.col("page_id")), field("payloadLength", F.col("n_bytes")),
                 field("revisitOf", F.when(F.col("revisit"), F.col("first_id")))),
    )
    text = F.concat(request, F.lit(RECORD_END), capture, F.lit(RECORD_END), metadata)
    placed.select(text.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def _fields(stream: io.BufferedIOBase) -> dict[str, str]:
    """Named fields, one a line, up to an empty line."""
    found = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.partition(b":")
        found[name.decode("utf-8", "replace").strip()] = value.decode("utf-8", "replace").strip()
    return found


def _records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of one archive; the length in a record's header, not its content, says where it ends."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {name.lower(): value for name, value in _fields(stream).items()}
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a WARC record is cut short")
        kind, payload, fields = head.get("warc-type", ""), block, {}
        if head.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif head.get("content-type", "").startswith("application/warc-fields"):
            fields = _fields(io.BytesIO(block))
        stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
        measured = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield {
            "type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"),
            "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
            "content_type": head.get("content-type"), "payload_bytes": len(payload),
            "payload_digest": (stated or measured) if kind == "revisit" else measured,
            "verified": None if kind == "revisit" or not stated else stated == measured, "fields": fields, "payload": payload,
        }


def _parse(files: Iterator[pd.DataFrame], with_payload: bool) -> Iterator[pd.DataFrame]:
    for batch in files:
        for content in batch["content"]:
            raw = io.BytesIO(content)
            stream = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
            rows, held = [], 0
            for record in _records(stream):
                held += len(record["payload"])
                if not with_payload:
                    record["payload"] = None
                rows.append(record)
                if held > BATCH_BYTES or len(rows) >= 2000:
                    yield pd.DataFrame(rows)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives (plain or gzip) below ``path``.

    A file is one task's unit and is unpacked as a stream. ``verified`` compares the payload with the
    digest in its header (null where there is nothing to compare).
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(lambda parts: _parse(parts, with_payload), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: its response or revisit, and the request and metadata written along with it.

    Requests and metadata name their capture in ``concurrent_to``; where there is none the struct is null,
    and where there are several one stays. ``records`` is read three times, so pass a written table.
    """
    capture = records.filter(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct(*records.columns).alias("response"))

    def beside(kind: str) -> DataFrame:
        rows = records.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return rows.select(F.col("concurrent_to").alias("capture_id"), F.struct(*records.columns).alias(kind)).dropDuplicates(["capture_id"])

    return capture.join(beside("request"), "capture_id", "left").join(beside("metadata"), "capture_id", "left")


def archive_round_trip(pages: DataFrame, path: str, with_payload: bool = True, **names: object) -> DataFrame:
    """Writes ``pages`` as archives below ``path`` and returns the captures read back from them."""
    write_warc(pages, path, **names)
    return assemble(cut_lineage(read_warc(pages.sparkSession, path, with_payload)))
