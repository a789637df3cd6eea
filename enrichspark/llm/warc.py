"""WARC archives: deduplicated writing, parsing, and assembly of transactions.

A capture is written as a request record, a response or revisit record, and a metadata record, tied by
WARC-Concurrent-To. Archives are gzip files written by Spark's text writer, whose line separator is the blank
line pair that closes a WARC record, so any file system Spark knows will do. Reading parses records by
Content-Length, then joins the three kinds through their concurrent-to identifiers into one nested row.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from enrichspark.session import shared_dir

MIN_REVISIT_BYTES = 1000
END = "\r\n\r\n"
FILE_RECORDS = 20_000

RECORD_SCHEMA = ("kind string, record_id string, concurrent_to string, refers_to string, target_uri string, "
                 "payload_bytes long, payload_digest string, stated_digest string, fields map<string,string>, payload binary")


def _record_id(kind: str, key) -> F.Column:
    """urn:uuid made from an md5 of the kind and the row's key, so that a rewritten archive is the same."""
    h = F.md5(F.concat_ws("|", F.lit(kind), key))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def decide(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html) with n_bytes, digest, copy and target.

    target: the largest page_id of the rows with an equal payload of min_bytes or more, where it isn't the row's
    own; null means the row is a response. A null html is an empty payload. A null page_id is never a target; rows
    without id revisit the response of their payload, and are responses where no row has an id. Repeated rows of
    the target are all responses. copy numbers rows of one page_id, so that record ids stay unique.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"n_bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.encode("html", "UTF-8"))})
    slim = p.filter(F.col("n_bytes") >= min_bytes).select("page_id", "digest")
    best = slim.groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # the html moves once, by page_id; the digest join carries ids only
    revisits = (slim.join(best, "digest").filter("page_id is not null and page_id <> best")
                .groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("digest", "best"))).alias("targets")))
    # joined by page_id alone, so that the numbering below finds its rows together
    named = p.filter("page_id is not null").join(revisits, "page_id", "left").withColumn("target", F.col("targets")[F.col("digest")])
    named = named.withColumn("copy", F.row_number().over(W.partitionBy("page_id").orderBy("digest", "url")))
    nameless = (p.filter("page_id is null").join(best.withColumnRenamed("best", "target"), "digest", "left")
                .withColumn("copy", F.monotonically_increasing_id() + 1))
    return named.select("page_id", "url", "html", "n_bytes", "digest", "target", "copy").unionByName(
        nameless.select("page_id", "url", "html", "n_bytes", "digest", "target", F.col("copy")))


def _block(headers: list, body) -> F.Column:
    lines = [F.lit("WARC/1.1")]
    for name, value in headers:
        lines.append(F.concat(F.lit(f"{name}: "), value))  # null drops the header line
    head = F.concat_ws("\r\n", *lines)
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body)


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write the records of pages below path; see decide for nulls and repeated rows. A null url is left out.

    The date of a record is fixed, because the input has none. Control characters in a url are percent-encoded.
    """
    d = decide(pages, min_bytes)
    key = F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.col("copy").cast("string"))
    uri = F.regexp_replace(F.regexp_replace("url", "[\\r\\n]", "%0A"), "[\\x00-\\x20]", "%20")
    rid, qid, mid = _record_id("response", key), _record_id("request", key), _record_id("metadata", key)
    date = ("WARC-Date", F.lit("2024-01-01T00:00:00Z"))
    sha = F.concat(F.lit("sha1:"), F.col("digest"))
    revisit = F.col("target").isNotNull()
    # the target's first row carries the copy number 1
    refers = F.when(revisit, _record_id("response", F.concat(F.col("target").cast("string"), F.lit("/1"))))
    response = _block([
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", rid), date, ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", sha), ("WARC-Refers-To", refers),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.when(revisit, "").otherwise(F.col("html"))))
    request = _block([
        ("WARC-Type", F.lit("request")), ("WARC-Record-ID", qid), date, ("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid),
        ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _block([
        ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", mid), date, ("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid),
        ("Content-Type", F.lit("application/warc-fields"))],
        F.concat_ws("", F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit("\r\n")),
                    F.concat(F.lit("fullPayloadBytes: "), F.col("n_bytes").cast("string"), F.lit("\r\n")),
                    F.concat(F.lit("refersToPage: "), F.col("target").cast("string"), F.lit("\r\n"))))
    (d.select(F.concat_ws(END, request, response, metadata).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parse_warc(stream) -> Iterator[dict]:
    """Records of one uncompressed WARC stream: headers in lower case and the block, cut by Content-Length."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield {"headers": headers, "block": stream.read(int(headers.get("content-length", 0)))}


def _rows(payloads: bool):
    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                stream = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                out = []
                for r in parse_warc(stream):
                    h, block = r["headers"], r["block"]
                    kind, fields, body = h.get("warc-type"), {}, b""
                    if kind in ("request", "response", "revisit"):
                        body = block.partition(b"\r\n\r\n")[2]
                    elif kind == "metadata":
                        for line in block.decode("utf-8", "replace").split("\r\n"):
                            name, sep, value = line.partition(":")
                            if sep:
                                fields[name.strip()] = value.strip()
                    stated = h.get("warc-payload-digest")
                    out.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"),
                                h.get("warc-target-uri"), len(body), hashlib.sha1(body).hexdigest(),
                                stated.partition(":")[2] if stated else None, fields, body if payloads else None))
                    if len(out) >= 2000:
                        yield pd.DataFrame(out, columns=COLUMNS)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=COLUMNS)
    return run


COLUMNS = [c.split()[0] for c in RECORD_SCHEMA.replace("map<string,string>", "map").split(", ")]


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives below path. Without payloads only their length and SHA-1 are returned."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_rows(payloads), RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, request, response, metadata), joined on concurrent-to identifiers.

    A capture is a response or revisit record; its request or metadata is null where none names it. Of several
    that name it the one with the smallest record id is taken. Records without id are left out.
    """
    cols = [c for c in COLUMNS if c not in ("kind", "concurrent_to")]
    res = records.filter("kind in ('response', 'revisit') and record_id is not null").select(
        "record_id", F.struct("kind", *cols).alias("response"))
    side = (records.filter("kind in ('request', 'metadata') and concurrent_to is not null")
            .groupBy(F.col("concurrent_to").alias("record_id"))
            .agg(F.min_by(F.struct("record_id", "target_uri"), F.when(F.col("kind") == "request", F.col("record_id"))).alias("request"),
                 F.min_by(F.struct("record_id", "fields"), F.when(F.col("kind") == "metadata", F.col("record_id"))).alias("metadata")))
    return res.join(side, "record_id", "left").select("record_id", "request", "response", "metadata")


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write pages, read the archives back, assemble them, and digest each capture.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url, has_request). An empty table gives an
    empty archive and no row. Of a response the length and digest are those of the payload read back; of a revisit
    they are those its records state.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, min_bytes)
    a = assemble(read_records(spark, path, payloads=False))
    revisit = F.col("response.kind") == "revisit"
    field = lambda name: F.col("metadata.fields")[name].cast("long")
    return a.select(
        field("pageId").alias("page_id"),
        F.when(revisit, field("fullPayloadBytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("response.stated_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.kind").alias("record_type"), field("refersToPage").alias("refers_to"),
        F.col("response.target_uri").alias("url"), F.col("request").isNotNull().alias("has_request"))
