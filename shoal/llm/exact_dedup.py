"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

The first pass counts hash positions, one number a row, and keeps as a bitmap
those hit at least twice; the second tests every row against the bitmap. Only
rows whose position was hit twice can have a copy: they alone are shuffled by
digest. All other rows pass straight through as groups of one. The bitmap is
broadcast in pieces of a bounded size; when there are several, digests are
written by piece, without a shuffle, and each meets its own piece.

Positions are counted as numbers, not merged as one bitmap per partition: a
partition sets at most one bit a row, which as a number takes eight bytes, while
its bitmap would take as many bits as all rows of the table need.

Defined results: null text counts as empty; texts equal after deleting ASCII
white space are copies; of copies the one with most code points, then smallest
doc_id (null last), then first row stays, so that of repeated rows one stays.
Columns other than the id and the text play no part, whatever their names; empty
input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from ._common import ASCII_SPACE, join_hot, stash, unused


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def repeated(hashes: DataFrame, hashed: Column, size: int) -> DataFrame:
    """First pass: (bucket, bitmap) of the positions that two rows or more hit."""
    twice = hashes.select(bitmaps.position(hashed, size).alias("pos")).groupBy("pos").count().where("count > 1")
    return stash(bitmaps.built(twice), "filter")


def _first(doc_id: str, points: str, rid: str) -> Column:
    """The row that stays."""
    return F.min(F.struct((-F.col(points)).alias("o"), F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("doc_id"), F.col(rid).alias("rid"))).alias("first")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = bitmaps.BITS_PER_ROW, piece_bytes: int = bitmaps.PIECE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_points."""
    text = docs[text_col]
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), digest(text).alias("text_sha256"), _points(text).alias("n_points"))
    narrow = stash(narrow.withColumn("rid", F.monotonically_increasing_id()), "digests")
    size = bitmaps.positions_for(narrow.count(), bits_per_row)
    hashed = F.xxhash64("text_sha256")
    pos, several = bitmaps.position(hashed, size), bitmaps.pieces(size, piece_bytes)
    seen = repeated(narrow, hashed, size)
    if several == 1:
        tested = bitmaps.tested(narrow, seen, pos, "maybe")
    else:
        path = narrow._stashed_at + "-pieces"
        narrow.withColumn("piece", bitmaps.piece_of(pos, size, piece_bytes)).write.partitionBy("piece").parquet(path)
        by_piece = docs.sparkSession.read.parquet(path)
        parts = [(by_piece.where(F.col("piece") == i).drop("piece"), seen.where(bitmaps.piece_of(F.col("bucket") * bitmaps.BITS, size, piece_bytes) == i)) for i in range(several)]
        tested = bitmaps.tested(*parts[0], pos, "maybe")
        for rows, members in parts[1:]:
            tested = tested.unionByName(bitmaps.tested(rows, members, pos, "maybe"))
    alone = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "n_points")
    hits = tested.where("maybe").select("doc_id", "text_sha256", "n_points", "rid")
    groups = hits.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), _first("doc_id", "n_points", "rid"))
    groups = stash(groups.select("text_sha256", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid")), "groups")
    grouped = join_hot(hits, groups, ["text_sha256"], "group_size").select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256", "n_points")
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = bitmaps.BITS_PER_ROW, piece_bytes: int = bitmaps.PIECE_BYTES) -> DataFrame:
    """docs without the rows that copies() drops, all columns kept.

    Rows that can't have a copy pass through; the others are written once, with
    a number each, and what stays of them is found by digest and joined by number.
    A filter of more than one piece tests its rows in as many passes over docs.
    """
    sha, points, rid, maybe = unused(docs, "text_sha", "points", "rid", "maybe")
    wide = docs.withColumn(sha, digest(docs[text_col]))
    hashes = stash(wide.select(F.xxhash64(sha).alias("h")), "hashes")
    size = bitmaps.positions_for(hashes.count(), bits_per_row)
    seen, pos = repeated(hashes, F.col("h"), size), bitmaps.position(F.xxhash64(sha), size)
    tested = None
    for i in range(bitmaps.pieces(size, piece_bytes)):
        in_piece = lambda at: bitmaps.piece_of(at, size, piece_bytes) == i  # noqa: B023, E731
        part = bitmaps.tested(wide.where(in_piece(pos)), seen.where(in_piece(F.col("bucket") * bitmaps.BITS)), pos, maybe)
        tested = part if tested is None else tested.unionByName(part)
    hits = tested.where(F.col(maybe)).withColumn(points, _points(F.col(f"`{text_col}`"))).withColumn(rid, F.monotonically_increasing_id())
    hits = stash(hits, "hits")
    stay = hits.groupBy(sha).agg(_first(f"`{id_col}`", points, rid)).select(F.col("first.rid").alias(rid))
    kept = hits.join(stay, rid, "left_semi")
    return tested.where(~F.col(maybe)).select(*docs.columns).unionByName(kept.select(*docs.columns))


def op3_exact_dedup(spark, sf_dir):
    return copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_points")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS k,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""
