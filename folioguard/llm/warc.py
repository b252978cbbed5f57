"""Operator 6: WARC archives with revisit records.

Headers (page_id, url, payload digest, length) are shuffled by digest without the payloads. In a group of
equal payloads of at least ``least`` bytes, rows with the smallest page_id are responses and all
others revisit it; smaller payloads are always responses. Records are then put together with fresh
headers and written by Spark's text writer, whose line separator is the blank line that ends a
WARC record. So a lost executor or a repeated task leaves whole files only.

A response's block is an HTTP message with the payload as its body, a revisit's that message's head alone. Record
ids are UUIDs made from type, page_id, digest and target, so a repeated task writes the same ones; only exact
repetitions of a row share one. A revisit names the id, target and date of its response.

Files hold at most ``file_bytes`` bytes or one record: records are written by classes of their length, each with as
many records a file as fit at the class's greatest length.

A hot digest (one payload in a third of all rows) is aggregated before the shuffle and joined by
broadcast: there can be fewer than HOT_SHARE digests with more than 1 / HOT_SHARE of the rows.

Null html counts as the empty payload. Rows with a null page_id are never referred to while another
row of the group has an id; in a group without any id all rows are responses. Rows that repeat the
smallest page_id with equal payload are all responses. A null url is written as an empty target.
Columns of the input with clashing names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.llm.common import nvl_text, read_table, scratch, shuffles_dropped, stored

LEAST = 100
HOT_SHARE = 512
#: Bytes and records of one file at most; a longer record has a file of its own. A reader's task holds one file at a time.
FILE_BYTES = 64 << 20
PER_FILE = 2_000
#: Greatest lengths of the classes of records; longer ones form the last class.
CLASSES = tuple(1 << k for k in (15, 18, 21, 24))
END = "\r\n\r\n"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload_ok boolean"


def payload_headers(pages: DataFrame, *more: F.Column) -> DataFrame:
    """page_id, url, digest, size of each row's payload, and columns beside them."""
    html = nvl_text("html")
    target = F.regexp_replace(nvl_text("url"), r"[\r\n]", "").alias("url")
    return pages.select("page_id", target, F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"), *more)


def resolve_revisits(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """The headers with refers_to, the response's page_id for revisits, else null, and target, the response's url."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    groups = headers.where(F.col("size") >= least).groupBy("digest").agg(first.alias("f"), F.count("*").alias("n")).where("n > 1")
    groups = stored(groups.select("digest", F.col("f.page_id").alias("first"), F.col("f.url").alias("target"), "n"), "digests")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT_SHARE > total
    met = headers.join(F.broadcast(groups.where(hot).drop("n")), "digest", "left")
    rest = met.where("first is null").drop("first", "target").join(groups.where(~hot).drop("n"), "digest", "left")
    both = met.where("first is not null").unionByName(rest)
    return both.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def _record_id(kind: str, page_id: F.Column, url: F.Column) -> F.Column:
    h = F.sha2(F.concat_ws("\n", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), F.col("digest"), url), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _number(c: str) -> F.Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _record(kind: str, payload: F.Column, date: str) -> F.Column:
    """A WARC record but for its closing blank line."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    length = F.octet_length(http) + (F.col("size") if kind == "response" else F.lit(0))
    lines = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(kind, F.col("page_id"), F.col("url"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Page-Id: "), _number("page_id")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    if kind == "revisit":
        lines[6:6] = [
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.concat(F.lit("WARC-Refers-To: "), _record_id("response", F.col("refers_to"), F.col("target"))),
            F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("target")),
            F.lit(f"WARC-Refers-To-Date: {date}"),
            F.concat(F.lit("X-Refers-To-Page: "), _number("refers_to")),
        ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), http, payload)


def _class(payload: str | None = "size", *targets: str) -> F.Column:
    """Number of a record's class, by a bound of its length with its headers."""
    length, out = F.lit(1024), F.lit(len(CLASSES))
    for c in targets or ("url",):
        length = length + 2 * F.octet_length(c)
    length = length + F.col(payload) if payload else length
    for k in reversed(range(len(CLASSES))):
        out = F.when(length <= CLASSES[k], k).otherwise(out)
    return out


def write_archives(pages: DataFrame, path: str, least: int = LEAST, per_file: int = PER_FILE, file_bytes: int = FILE_BYTES, date: str | None = None) -> None:
    """Write the deduplicated archives of ``pages`` (page_id, url, html) under ``path``; ``date`` is that of all records, now by default.

    Only the ids of revisits (a few bytes a row) meet the payloads, by an anti-join.
    """
    spark, date = pages.sparkSession, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    headers = stored(payload_headers(pages), "headers")
    revisits = resolve_revisits(headers, least).where("refers_to is not null").withColumn("class", _class(None, "url", "target"))
    revisits = stored(revisits, "revisits")
    present = {r.c for r in headers.select(_class().alias("c")).unionByName(revisits.select(F.col("class").alias("c"))).distinct().collect()}
    full = payload_headers(pages, nvl_text("html").alias("html"))
    gone = revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("url").alias("u")).distinct()
    same = full.page_id.eqNullSafe(gone.p) & (full.digest == gone.d) & (full.url == gone.u)
    for k in sorted(present | {0}):
        most = max(1, min(per_file, file_bytes // CLASSES[k])) if k < len(CLASSES) else 1
        records = full.where(_class() == k).join(gone, same, "left_anti").select(_record("response", F.col("html"), date).alias("value"))
        records = records.unionByName(revisits.where(F.col("class") == k).select(_record("revisit", F.lit(""), date).alias("value")))
        with shuffles_dropped(spark):
            records.write.option("lineSep", END).option("maxRecordsPerFile", most).text(f"{path}/class{k}")


def parse_archive(data: bytes) -> Iterator[tuple]:
    """Each record of an archive: the fields of RECORD. Blocks are passed over by their length."""
    at, number = 0, lambda s: int(s) if s else None
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        start = stop + 4
        end = start + int(head["Content-Length"])
        body = data.index(b"\r\n\r\n", start, end) + 4
        http = dict(x.split(": ", 1) for x in data[start : body - 4].decode("ascii").split("\r\n")[1:])
        digest, kind, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"], int(http["Content-Length"])
        ok = kind == "revisit" or (end - body == size and hashlib.sha256(data[body:end]).hexdigest() == digest)
        yield number(head["X-Page-Id"]), size, digest, kind, number(head.get("X-Refers-To-Page")), head["WARC-Target-URI"], ok
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record does not end at byte {end}")
        at = end + 4


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    for batch in batches:
        for content in batch.column("content"):
            rows = list(parse_archive(content.as_py()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in RECORD.split(", ")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``; a payload that does not match its digest has payload_ok false."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_parse_batches, RECORD)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok")


OP6_SQL = """
WITH h AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM h)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to,
       true AS payload_ok
FROM f
"""
