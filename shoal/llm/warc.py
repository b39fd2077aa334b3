"""WARC archives with revisit resolution.

Headers (payload digest and page id) are shuffled by digest, and revisit records
are joined to their original responses; payloads are not shuffled. A revisit is
written from its header alone. A response is written by the task that reads its
page, which has to know that it is no revisit: the keys of all revisits go into
a bitmap, the keys of responses that hit it by chance into a second one, those of
revisits that hit that into a third, and so on until no key is mistaken. Together
they decide every row exactly. They are broadcast while they are small; beyond
that, pages are joined to the keys of the revisits by shuffle.

Archives are written by Spark's own text writer, whose separator is the blank
lines that end a WARC record, so that any file system of the cluster serves and
failed tasks leave no files. They are read back as a stream of the same lines,
record by record by their Content-Length, so that a file may have any size.

Defined results: a null payload is empty; equal payloads of at least min_bytes
bytes are one response (smallest page_id, null last) and revisits; rows that
repeat the smallest page_id with the same payload are responses as well; control
characters and spaces in a URL are percent-encoded, a null URL becomes urn:page.
Columns other than the three named play no part. Empty input gives an empty
archive and no rows.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from ._common import join_hot, scratch, small_batches, stash

END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, block_bytes long, block_crc32 long"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four digits for each 20 bits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest)."""
    payload = F.coalesce(pages[payload_col], F.lit(""))
    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))


def revisits(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The headers (page_id, url, payload_bytes, payload_digest) that revisit another one, with refers_to."""
    large = heads.where(F.col("payload_bytes") >= min_bytes)
    first = F.min(F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("page_id"))).alias("first")
    origins = large.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("times"), first).where("times > 1")
    origins = stash(origins.select("payload_digest", "times", F.col("first.page_id").alias("refers_to")), "origins")
    return join_hot(large, origins, ["payload_digest"], "times").drop("times").where("not page_id <=> refers_to")


def responses(records: DataFrame, heads: DataFrame, again: DataFrame, small_bytes: int = bitmaps.SMALL_BYTES) -> DataFrame:
    """records without those that revisit another one."""
    on = ["payload_digest", "page"]
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    members = stash(again.select("payload_digest", page.alias("page")).distinct(), "members")
    others = stash(heads.select("payload_digest", page.alias("page")).join(members, on, "left_anti"), "others")
    return bitmaps.outside(records.withColumn("page", page), members, others, on, ["hit", "verdict"], small_bytes).drop("page")


def resolve(records: DataFrame, min_bytes: int = 0, small_bytes: int = bitmaps.SMALL_BYTES) -> DataFrame:
    """records with record_type and refers_to; revisits come without their payload."""
    heads = stash(records.drop("payload"), "heads")
    again = stash(revisits(heads, min_bytes), "revisits")
    origin = responses(records, heads, again, small_bytes).withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long"))
    return origin.unionByName(again.withColumn("payload", F.lit("")).withColumn("record_type", F.lit("revisit")))


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def record_text(date: str = "2024-01-01T00:00:00Z") -> Column:
    """A whole record but for the blank lines that end it."""
    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))), "[\\x00-\\x1f\\x7f]", "%00"), " ", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _uri(F.col("page_id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", _uri(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")), F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def write_archive(records: DataFrame, path: str, records_per_file: int = 100_000) -> None:
    """Write resolved records as gzip-compressed archives of at most records_per_file records."""
    out = records.select(record_text().alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(parts):
    """(headers, block) of every record of a stream cut at END, one after the other.

    A block that ends with a line end begins the END after it: then the next
    record's headers follow in the same part.
    """
    gap = END.encode()
    head, held, size, need = None, [], 0, 0

    def opened(part):
        found = dict(re.findall(r"^([^:\r\n]+): ?(.*?)\r?$", part.decode(), re.M))
        return found, int(found["Content-Length"])

    for part in parts:
        if head is None:
            part = part.lstrip(b"\r\n")
            if part:
                head, need = opened(part)
                held, size = [], -len(gap)
            continue
        held.append(part)
        size += len(gap) + len(part)
        while head is not None and size >= need:
            block = gap.join(held)
            yield head, block[:need]
            part = block[need:].lstrip(b"\r\n")
            head, held, size = None, [], -len(gap)
            if part:
                head, need = opened(part)
    if head is not None:
        if need and size + len(gap) < need:
            raise ValueError(f"record {head['WARC-Record-ID']} is cut off")
        yield head, (gap.join(held) + gap)[:need]


def _page(uri: str | None) -> int | None:
    number = (uri or "")[len("<urn:page:") : -1]
    return None if number in ("", "null") else int(number)


def _rows(batches):
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("block_bytes", pa.int64()), ("block_crc32", pa.int64())]
    lines = (line.as_buffer().to_pybytes() for batch in batches for line in batch.column("value"))
    rows = []
    for head, block in parse(lines):
        rows.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), _page(head.get("WARC-Refers-To")), len(block), zlib.crc32(block)))
        if len(rows) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def read_archive(spark, path: str) -> DataFrame:
    """One row per record of the archives below path; gzip files aren't split, so that a task reads a file's lines in order."""
    small_batches(spark)
    return spark.read.option("lineSep", END).text(path).mapInArrow(_rows, SCHEMA)


def op5_warc(spark, sf_dir):
    path = scratch(spark) + "/warc"
    write_archive(resolve(headers(spark.read.parquet(f"{sf_dir}/pages.parquet"))), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, translate(
  lpad(to_base(('0x' || substr(h, 1, 5))::BIGINT, 32), 4, '0') || lpad(to_base(('0x' || substr(h, 6, 5))::BIGINT, 32), 4, '0') ||
  lpad(to_base(('0x' || substr(h, 11, 5))::BIGINT, 32), 4, '0') || lpad(to_base(('0x' || substr(h, 16, 5))::BIGINT, 32), 4, '0') ||
  lpad(to_base(('0x' || substr(h, 21, 5))::BIGINT, 32), 4, '0') || lpad(to_base(('0x' || substr(h, 26, 5))::BIGINT, 32), 4, '0') ||
  lpad(to_base(('0x' || substr(h, 31, 5))::BIGINT, 32), 4, '0') || lpad(to_base(('0x' || substr(h, 36, 5))::BIGINT, 32), 4, '0'),
  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS origin FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM f
"""
