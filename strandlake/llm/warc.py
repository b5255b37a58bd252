"""WARC archives with revisit resolution.

Record headers (page id, payload digest, size) are shuffled by digest to find
the record that keeps each payload, and joined to it; what comes back to the
pages is the list of revisits only, counted first and broadcast while it is
small, so that payloads stay where they are. One pass for each class of sizes
that occurs writes archives in which every payload is stored once, later copies
being revisit records with fresh headers that refer to the response. Archives
are written by Spark's text sink, a record per line of text ending in CR LF CR
LF, so they are committed by task and land on any store that Spark can write; a
file is one gzip stream and holds ``FILE_BYTES`` of payloads at most, or one
record. Reading parses each file as it is decompressed, follows Content-Length,
checks every response's digest and never splits on payload contents.

Defined results: null html is the empty payload; null or blank url becomes
urn:unknown, control characters and spaces in it are percent-encoded; of
repeated rows of one page_id and payload each is written; rows with null
page_id are responses; payloads under ``least`` bytes are never revisits; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import BROADCAST_IDS, Scratch, table
from strandlake.scratch import temporary

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payload bytes of a file at most, unless a single record has more, and the sizes up to which classes of payloads go.
FILE_BYTES, SIZES = 64 << 20, (1 << 16, 1 << 20, 1 << 24)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8: twenty bits, four letters at a time."""
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(F.sha1(text), 1 + 5 * i, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), digest, n (bytes)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return own.withColumn("digest", base32_sha1(F.col("html"))).withColumn("n", F.octet_length("html").cast("long"))


def owners(found: DataFrame, least: int = 0) -> DataFrame:
    """digest, owner: the largest page_id with each payload of at least ``least`` bytes."""
    return found.filter(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("owner"))


def revisits(keys: DataFrame, least: int = 0) -> DataFrame:
    """page_id, digest, owner of the records (page_id, digest, n) whose payload another one keeps, each pair once."""
    big = keys.filter(F.col("n") >= least)
    return big.join(owners(keys, least), "digest").filter("page_id <> owner").select("page_id", "digest", "owner").distinct()


def _urn(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def records(joined: DataFrame) -> DataFrame:
    """One column, value: the text of each record without its last line feed. joined: headers, and the owner of revisits."""
    revisit = F.col("owner").isNotNull()
    uri = F.when(F.trim(F.coalesce("url", F.lit(""))) == "", F.lit("urn:unknown")).otherwise(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("owner")))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-Id: "), F.col("owner").cast("string"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return joined.select(F.concat(F.concat_ws(END, *lines), F.lit(END + END), block, F.lit(END + "\r")).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes gzipped archives of all pages into the folder path, which must not exist."""
    every = headers(pages)
    with Scratch(pages.sparkSession) as scratch:
        keys = scratch.cut(every.select("page_id", "digest", "n"), "op9-headers")
        again = scratch.cut(revisits(keys, least), "op9-revisits")
        if again.count() <= BROADCAST_IDS:
            again = F.broadcast(again)
        edges = [-1, *SIZES, float("inf")]
        low, high = edges[:-1], edges[1:]
        found = keys.agg(*(F.count_if((F.col("n") > a) & (F.col("n") <= b)) for a, b in zip(low, high, strict=True))).first()
        mode = "errorifexists"
        for a, b, n in zip(low, high, found, strict=True):
            if n or (a < 0 and not any(found)):  # no pages: an empty folder
                own = every.filter((F.col("n") > a) & (F.col("n") <= b)).join(again, ["page_id", "digest"], "left")
                per_file = max(1, int(FILE_BYTES // b)) if b < edges[-1] else 1
                records(own).write.mode(mode).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
                mode = "append"


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} does not end where it says")
        yield fields, block


FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each record; with its payload (null for revisits) if asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else ())]
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for fields, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    head, _, body = block.partition(b"\r\n\r\n")
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind = fields["warc-type"]
                    length = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    if kind == "response" and (len(body) != length or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"record {fields['warc-record-id']} has another payload than its header says")
                    page, other = fields["x-page-id"], fields.get("x-refers-to-page-id")
                    rows.append((int(page) if page else None, fields["warc-target-uri"], length, digest, kind, int(other) if other else None, *([body if kind == "response" else None] if payload else ())))
                    if len(rows) >= 1000:
                        yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, FOUND + (", payload binary" if payload else ""))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = temporary(spark, "op9-archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL_LETTERS = " || ".join(f"substr('{BASE32}', CAST((CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT) >> {s}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
OP9_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, {_SQL_LETTERS} AS payload_digest FROM p),
o AS (SELECT payload_digest, max(page_id) AS owner FROM d GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN d.page_id <> o.owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id <> o.owner THEN o.owner END AS refers_to
FROM d JOIN o ON o.payload_digest = d.payload_digest
"""
