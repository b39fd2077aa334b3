"""Quality classifier: a factorisation machine.

Low-rank pairwise interactions among hashed words, structure statistics and
metadata (the length in bytes), scored in linear time by the identity
sum of squares: 2 * sum over pairs = (sum)^2 - sum of squares, for each factor.

Defined results: a null text is empty; a document without words is scored by its
statistics; a null doc_id counts as the text '' in the fold rule; several labels
of a doc_id count as their least; null labels aren't used; without any usable
label every score is 1. At most max_rows labelled rows are fitted on, those with
the smallest hash of their doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import keyed, small_batches
from ._words import stretches, words_of

#: Hashed words, bins of a statistic, and factors.
BUCKETS, BINS, RANK = 1 << 14, 16, 8
#: Bound of the rows to fit on.
MAX_ROWS = 6000
_STATISTICS = 12


_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_EDGE = np.isin(np.arange(256), np.frombuffer(b".,;:!?'\"()-", dtype=np.uint8))
_SIZE = BUCKETS + _STATISTICS * BINS


def _bin(x: np.ndarray, root: bool = False) -> np.ndarray:
    x = np.clip(np.nan_to_num(x), 0, 1)
    return np.minimum(BINS - 1, ((np.sqrt(x) if root else x) * BINS).astype(np.int64))


def features_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index and value of each feature of each text: hashed words, then the bin of each statistic."""
    for _, data, offsets in stretches(column):
        w = words_of(data, offsets)
        sums = lambda mask: np.concatenate(([0], np.cumsum(mask)))
        of_text = lambda s: s[offsets[1:]] - s[offsets[:-1]]
        of_words = lambda x: (lambda s: s[w.bounds[1:]] - s[w.bounds[:-1]])(np.concatenate(([0], np.cumsum(x))))
        letters, edges = sums(_LETTER[data]), sums(_EDGE[data])
        digits, upper = sums((data >= 48) & (data < 58)), sums((data >= 65) & (data < 91))
        inside = lambda s: s[w.ends] - s[w.starts]
        length = w.ends - w.starts
        n = np.maximum(1, w.bounds[1:] - w.bounds[:-1])
        size = np.maximum(1, offsets[1:] - offsets[:-1])
        again = np.concatenate((w.hashes[1:] == w.hashes[:-1], [False])) if len(w.hashes) else np.zeros(0, bool)
        inner = w.bounds[1:-1][(w.bounds[1:-1] > 0) & (w.bounds[1:-1] <= len(again))]
        again[inner - 1] = False  # the last word of a text has none after it
        stops = of_text(sums(np.isin(data, (33, 46, 63))))
        table = [
            np.minimum(BINS - 1, np.log2(n + 1).astype(np.int64)), np.minimum(BINS - 1, np.log2(size + 1).astype(np.int64)), None, None, np.minimum(BINS - 1, (of_words(length) / n * 1.5).astype(np.int64)),
            _bin(of_words(inside(letters) * 2 < length) / n, True), _bin(of_words(inside(letters) + inside(edges) < length) / n, True), _bin(of_words(inside(digits) > 0) / n, True), _bin(of_text(upper) / size, True),
            _bin(of_words(again) / n, True), _bin(of_text(sums(data == 10)) / n, True), _bin(stops / n, True),
        ]
        buckets = (w.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        for i, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:], strict=True)):
            index, count = np.unique(buckets[a:b], return_counts=True)
            bins = [_bin(len(index) / n[i]) if c == 2 else _bin((count.max() if len(count) else 1) / n[i], True) if c == 3 else x[i] for c, x in enumerate(table)]
            value = 1 + np.log(count)
            norm = np.sqrt((value * value).sum())
            yield np.concatenate((index, BUCKETS + np.arange(_STATISTICS) * BINS + np.asarray(bins, dtype=np.int64))), np.concatenate((value / norm if norm else value, np.ones(_STATISTICS)))


class FactorisationMachine:
    def __init__(self, size: int, rank: int = RANK, seed: int = 0):
        self.bias = 0.0
        self.table = np.random.default_rng(seed).normal(0, 0.05, (size, rank + 1)).astype(np.float32)
        self.table[:, 0] = 0

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        part = self.table[index] * value[:, None].astype(np.float32)
        total = part.sum(axis=0, dtype=np.float64)
        return self.bias + total[0] + 0.5 * float((total[1:] ** 2).sum() - (part[:, 1:].astype(np.float64) ** 2).sum())

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(index, value), -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.08, decay: float = 1e-4, seed: int = 0) -> FactorisationMachine:
        """Adagrad over mini-batches of the logistic loss."""
        rng = np.random.default_rng(seed)
        squares, square = np.full(self.table.shape, 1e-2, dtype=np.float32), 1e-2
        mean = float(np.clip(labels.mean(), 0.01, 0.99))
        self.bias = float(np.log(mean / (1 - mean)))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for start in range(0, len(rows), batch):
                chosen = order[start : start + batch]
                index = np.concatenate([rows[i][0] for i in chosen])
                value = np.concatenate([rows[i][1] for i in chosen]).astype(np.float32)
                ends = np.cumsum([len(rows[i][0]) for i in chosen])
                starts = ends - [len(rows[i][0]) for i in chosen]
                part = self.table[index] * value[:, None]
                total = np.add.reduceat(part, starts, axis=0)
                raw = self.bias + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(1) - np.add.reduceat((part[:, 1:] ** 2).sum(1), starts))
                wrong = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]).astype(np.float32) / len(chosen)
                each = np.repeat(np.arange(len(chosen)), ends - starts)
                slope = np.empty_like(part)
                slope[:, 0] = value
                slope[:, 1:] = value[:, None] * (total[each, 1:] - part[:, 1:])
                slope *= wrong[each, None]
                used, where = np.unique(index, return_inverse=True)
                line = np.argsort(where, kind="stable")
                grad = np.add.reduceat(slope[line], np.searchsorted(where[line], np.arange(len(used))), axis=0) + decay * self.table[used]
                squares[used] += grad * grad
                self.table[used] -= rate * grad / np.sqrt(squares[used])
                step = float(wrong.sum())
                square += step * step
                self.bias -= rate * step / np.sqrt(square)
        return self


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _featured(batches):
    for batch in batches:
        both = list(features_of(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([i.tolist() for i, _ in both], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in both], pa.list_(pa.float32()))], ["y", "index", "value"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, all_folds: bool = False, seed: int = 0) -> FactorisationMachine | None:
    """Fit on at most max_rows labelled documents outside the held-out fold."""
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y is not null")
    known = known if all_folds else known.where(fold(F.col("id")) != 0)
    sample = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    small_batches(docs.sparkSession)
    # of rows that repeat a doc_id the least text is learned
    texts = keyed(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    got = texts.select("doc_id", "text", "y").mapInArrow(_featured_with_id, "doc_id long, y int, index array<int>, value array<float>").toPandas()
    if not len(got):
        return None
    got = got.sort_values("doc_id")
    rows = [(np.asarray(i), np.asarray(v)) for i, v in zip(got["index"], got["value"], strict=True)]
    return FactorisationMachine(_SIZE, seed=seed).fit(rows, got["y"].to_numpy(dtype=np.float32), seed=seed)


def _featured_with_id(batches):
    for batch in batches:
        for out in _featured([batch]):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out.columns], ["doc_id", "y", "index", "value"])


def _scorer(model: FactorisationMachine | None):
    def score(batches):
        for batch in batches:
            scores = [model.score(*x) if model else 1.0 for x in features_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(scores, pa.float64())], ["key", "doc_id", "score"])

    return score


def score(docs: DataFrame, model: FactorisationMachine | None) -> DataFrame:
    """(key, doc_id, score) of every row."""
    small_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(_scorer(model), "key binary, doc_id long, score double")


def keep(docs: DataFrame, model: FactorisationMachine | None, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of threshold at least, all columns kept; rows are neither joined nor shuffled."""
    small_batches(docs.sparkSession)

    def scored(batches):
        for batch in batches:
            text = batch.column(text_col).cast(pa.large_string()).fill_null("")
            good = [model is None or model.score(*x) >= threshold for x in features_of(text)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(scored, docs.schema)


def op10_quality(spark, sf_dir, threshold: float = 0.3):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
