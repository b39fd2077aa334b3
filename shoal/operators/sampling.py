"""Samples by size, distinct samples, and rows with independent columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_fraction(n: int, size: int) -> float:
    if n < 0 or size < 0:
        raise ValueError("sizes can't be negative")
    return min(1.0, size / n) if n and size else 0.0


def sample_by_size(df: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """About size rows (an expectation), or all."""
    fraction = sample_fraction(df.count(), size)
    return df if fraction >= 1.0 else df.sample(False, fraction, seed)


def sample_distinct(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k distinct rows; too few are an error."""
    text = F.to_json(F.struct(*df.columns))
    out = df.distinct().withColumn("_u", F.xxhash64(text, F.lit(seed))).orderBy("_u", text).limit(k).drop("_u")
    if out.count() < k:
        raise ValueError(f"fewer than {k} distinct rows")
    return out


def _drawn(seed: int, counters: np.ndarray, n: int) -> np.ndarray:
    """Whole numbers below n, drawn by seed and counter alone: the finisher of SplitMix64, all of a batch at once."""
    x = counters * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed + 1) * 0xD1342543DE82EF95 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
    return np.minimum((x.astype(float) * (n * 2.0**-53)).astype(np.int64), n - 1)


def iid_features(df: DataFrame, n: int, features: str = "features", sample_size: int = 10_000, seed: int = 0) -> DataFrame:
    """n rows (row, features) whose columns keep their marginals, up to sampling, but are independent.

    The marginals come from at most about sample_size rows, or all if none was drawn.
    """
    if n <= 0:
        return df.sparkSession.createDataFrame([], "row long, features array<double>")
    rows = sample_by_size(df, sample_size, seed).select(features).collect() or df.select(features).limit(sample_size).collect()
    if not rows:
        raise ValueError("no rows to sample from")
    widths = {len(r[0]) for r in rows}
    if len(widths) > 1:
        raise ValueError("rows differ in width")
    table = np.array([list(map(float, r[0])) for r in rows])

    def draw(batches):
        import pyarrow as pa

        width = table.shape[1]
        for batch in batches:
            rows = batch.column(0).to_numpy()
            at = _drawn(seed, rows[:, None].astype(np.uint64) * np.uint64(width) + np.arange(width, dtype=np.uint64), len(table))
            values = pa.array(table[at, np.arange(width)].ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["row", "features"])

    return df.sparkSession.range(n).mapInArrow(draw, "row long, features array<double>")


def marginals(df: DataFrame, features: str = "features") -> DataFrame:
    """(place, zeros, ones, others): of each place of an array the number of zeros and ones, and the other values with theirs, in order."""
    counts = df.select(F.posexplode(features).alias("place", "x")).groupBy("place", "x").agg(F.count(F.lit(1)).alias("n"))
    x, n = F.col("x"), F.col("n")
    other = F.when((x != 0) & (x != 1), F.struct("x", "n"))
    return counts.groupBy("place").agg(F.coalesce(F.sum(F.when(x == 0, n)), F.lit(0)).alias("zeros"), F.coalesce(F.sum(F.when(x == 1, n)), F.lit(0)).alias("ones"), F.array_sort(F.collect_list(other)).alias("others"))
