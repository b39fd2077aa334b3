"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers. In each block of rows, ordered by id, an
attribute is a stack of bitmaps, one for each bit of its value above the block's
least one. A query's score is a sum of slices, each weighted by a power of two
for every bit of the query's component: full adders (three bitmaps to two) add
them with bitmap arithmetic. The top rows are selected from the score's most
significant slice downward; rows that tie at the boundary have equal scores, and
the smallest ids among them are taken, so that the result is exact.

Queries meet all rows in blocks: blocks of queries, which are a small part of the
rows, are sent to every block of rows, whose index is built once where its rows
are gathered. While there are fewer blocks of rows than TASKS, a block is
gathered in several places, each of which takes a share of the queries. A block's
answers are at most k per query.

Defined results: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; vectors of different length count as
filled up with zeros; a query's own row is any row of its id. Rows that repeat
another id are candidates of their own. Empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import stash

BLOCK_ROWS, BLOCK_QUERIES = 32768, 128
#: Places at which few blocks of rows are gathered.
TASKS = 24
RESULT = "query_id long, vec_id long, score long"


class BitSliced:
    """Bitmaps of the bits of every attribute of a block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.rows, self.width = values.shape
        self.low = values.min(axis=0)
        lifted = (values - self.low).astype(np.uint64)
        self.bits = max(1, int(lifted.max()).bit_length())
        words = -(-self.rows // 64)
        packed = np.zeros((self.width, self.bits, words * 8), dtype=np.uint8)
        for j in range(self.bits):
            part = np.packbits(((lifted >> np.uint64(j)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
            packed[:, j, : part.shape[1]] = part
        self.slices = packed.view(np.uint64)
        self.all = np.packbits(np.ones(self.rows, np.uint8), bitorder="little")
        self.all = np.pad(self.all, (0, words * 8 - len(self.all))).view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores, least significant first, and the number to add to each score."""
        query = query.astype(object)
        constant = int((query * self.low.astype(object)).sum())
        top = (1 << self.bits) - 1
        weight = np.array([abs(int(q)) for q in query], dtype=np.int64)
        negative = np.array([q < 0 for q in query])
        constant -= top * int(weight[negative].sum())
        if len(weight) == 0 or not weight.any():
            return [], constant
        # |q| * (top - v) for negative components: the bitmaps' complements
        flipped = np.where(negative[:, None, None], ~self.slices & self.all, self.slices)
        out, stack = [], {}
        for i in range(int(weight.max()).bit_length()):
            chosen = flipped[(weight >> i) & 1 == 1]
            for j in range(self.bits):
                stack.setdefault(i + j, []).append(chosen[:, j])
        place = 0
        while any(k >= place for k in stack):
            layers = np.concatenate(stack.pop(place)) if place in stack else np.zeros((0, len(self.all)), np.uint64)
            while len(layers) > 1:
                third = len(layers) // 3
                if not third:
                    a, b = layers
                    carry, layers = (a & b)[None], (a ^ b)[None]
                else:
                    a, b, c = layers[:third], layers[third : 2 * third], layers[2 * third : 3 * third]
                    either = a ^ b
                    carry = (a & b) | (c & either)
                    layers = np.concatenate((either ^ c, layers[3 * third :]))
                stack.setdefault(place + 1, []).append(carry)
            out.append(layers[0] if len(layers) else np.zeros_like(self.all))
            place += 1
        return out, constant

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k highest rows but those of id own, ties to smaller ids."""
        slices, constant = self.scores(query)
        left = self.all.copy()
        for at in range(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")):
            left[at >> 6] &= ~np.uint64(1 << (at & 63))
        sure, missing = np.zeros_like(left), k
        for bits in reversed(slices):
            high = left & bits
            n = int(np.bitwise_count(high).sum())
            if n > missing:
                left = high
            else:
                sure |= high
                left &= ~bits
                missing -= n
                if not missing:
                    break
        at = np.concatenate((self._rows(sure), self._rows(left)[:missing]))
        scores = np.full(len(at), constant, dtype=np.int64)
        for place, bits in enumerate(slices):
            scores += ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << place
        return self.ids[at], scores

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _blocker(pdf):
    import pandas as pd

    values = np.zeros((len(pdf), int(pdf["width"].max())), dtype=np.int32)
    for row, v in enumerate(pdf["q"]):
        values[row, : len(v)] = v
    ids = pdf["vec_id"].to_numpy(dtype=np.int64)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [ids.tobytes()], "vectors": [values.tobytes()]})


def _searcher(k: int):
    def unpack(row):
        ids = np.frombuffer(row["ids"], dtype=np.int64)
        return ids, np.frombuffer(row["vectors"], dtype=np.int32).reshape(len(ids), -1).astype(np.int64)

    def search(batches):
        held, index = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if not row["asks"]:  # a block's rows come before its queries
                    held, index = (row["block"], row["share"]), BitSliced(*unpack(row))
                    continue
                if held != (row["block"], row["share"]):
                    continue
                queries, values = unpack(row)
                width = min(values.shape[1], index.width)
                out = []
                for own, q in zip(queries, values, strict=True):
                    full = np.zeros(index.width, dtype=np.int64)
                    full[:width] = q[:width]
                    ids, scores = index.top(full, int(own), k)
                    out += [(int(own), int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return search


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, q, width): floor(scale * x) of each component of the vectors that take part."""
    v = vectors[vector_col]
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(vectors[id_col].isNotNull() & v.isNotNull()).where(whole)
    return rows.select(rows[id_col].cast("long").alias("vec_id"), F.transform(rows[vector_col], lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("q"), F.greatest(F.size(rows[vector_col]), F.lit(1)).alias("width"))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of each query (id divisible by every)."""
    rows = stash(quantised(vectors, id_col, vector_col), "quantised")
    n, n_queries = rows.count(), rows.where(F.col("vec_id") % every == 0).count()
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_queries // BLOCK_QUERIES))
    shares = min(query_blocks, -(-TASKS // blocks))
    deal = lambda df, m: df.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(m)))
    packed = lambda df, m: deal(df, m).groupBy("block").applyInPandas(_blocker, "block long, ids binary, vectors binary")
    numbers = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    index = packed(rows, blocks).select("block", numbers(shares).alias("share"), F.lit(False).alias("asks"), "ids", "vectors")
    asked = packed(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "q"]), query_blocks)
    asked = asked.select(numbers(blocks).alias("block"), F.pmod("block", F.lit(shares)).alias("share"), F.lit(True).alias("asks"), "ids", "vectors")
    met = index.unionByName(asked).repartition("block", "share").sortWithinPartitions("block", "share", "asks")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = met.mapInArrow(_searcher(k), RESULT).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM e),
s AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x)::BIGINT AS score
      FROM c a JOIN c b ON a.i = b.i AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
