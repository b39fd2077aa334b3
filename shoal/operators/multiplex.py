"""Several outputs of one pass, and splits into samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = StorageLevel.MEMORY_AND_DISK


def mux(df: DataFrame, bucket: str, outputs: Sequence[Column], level: StorageLevel = LEVEL) -> list[DataFrame]:
    """n aggregates per bucket in one pass; the j-th frame has (bucket, value) of the j-th."""
    held = df.groupBy(bucket).agg(*[c.alias(f"_{j}") for j, c in enumerate(outputs)]).persist(level)
    return [held.select(bucket, F.col(f"_{j}").alias("value")) for j in range(len(outputs))]


def _types(value: str | Sequence[str], n: int) -> list[str]:
    if n < 0:
        raise ValueError("a negative number of outputs")
    types = [value] * n if isinstance(value, str) else list(value)
    if len(types) != n:
        raise ValueError(f"{len(types)} types for {n} outputs")
    return types


def _checked(got: list, n: int) -> list:
    if len(got) != n:
        raise ValueError(f"{len(got)} outputs instead of {n}")
    return got


def mux_with(df: DataFrame, bucket: str, n: int, f: Callable, value: str | Sequence[str], level: StorageLevel = LEVEL) -> list[DataFrame]:
    """mux by a Python function f(bucket, pandas rows) of n values, all of the type named or each of its own; other numbers of values are an error."""
    types = _types(value, n)

    def run(key, pdf):
        import pandas as pd

        got = _checked(list(f(key[0], pdf)), n)
        return pd.DataFrame([(key[0], *got)], columns=["bucket", *[f"v{j}" for j in range(n)]])

    schema = ", ".join([f"bucket {dict(df.dtypes)[bucket]}", *[f"v{j} {t}" for j, t in enumerate(types)]])
    held = df.groupBy(bucket).applyInPandas(run, schema).persist(level)
    return [held.select("bucket", F.col(f"v{j}").alias("value")) for j in range(n)]


def flat_mux(df: DataFrame, outputs: Sequence[tuple[Column, Column]], level: StorageLevel = LEVEL) -> list[DataFrame]:
    """Route rows: the j-th frame has the j-th value of the rows where the j-th condition holds."""
    held = df.select(*[x for j, (when, value) in enumerate(outputs) for x in (F.coalesce(when, F.lit(False)).alias(f"w{j}"), value.alias(f"v{j}"))]).persist(level)
    return [held.where(f"w{j}").select(F.col(f"v{j}").alias("value")) for j in range(len(outputs))]


def flat_mux_with(df: DataFrame, bucket: str, n: int, f: Callable, value: str | Sequence[str], level: StorageLevel = LEVEL, by_rows: bool = False) -> list[DataFrame]:
    """flat_mux by a Python function f(bucket, pandas rows) of n sequences, all of the type named or each of its own.

    f gets all rows of a bucket at once, which a Python worker holds, unless by_rows says that what f makes of a row
    doesn't depend on other rows: then it gets a bucket in pieces, where its rows are.
    """
    types = _types(value, n)
    names = ["bucket", "j", *[f"v{j}" for j in range(n)]]

    def made(key, pdf):
        import pandas as pd

        for j, x in enumerate(_checked(list(f(key, pdf)), n)):
            x = list(x)
            if x:
                values = pd.Series(x, dtype=object)  # whole numbers beside nulls stay whole
                yield pd.DataFrame({"bucket": [key] * len(x), "j": j, **{f"v{i}": values if i == j else None for i in range(n)}}, columns=names)

    def whole(key, pdf):
        import pandas as pd

        parts = list(made(key[0], pdf))
        return pd.concat(parts) if parts else pd.DataFrame([], columns=names, dtype=object)

    def pieces(batches):
        for pdf in batches:
            for key, part in pdf.groupby(bucket, dropna=False, sort=False):
                yield from made(None if key != key else key, part.reset_index(drop=True))

    schema = ", ".join([f"bucket {dict(df.dtypes)[bucket]}", "j int", *[f"v{j} {t}" for j, t in enumerate(types)]])
    held = (df.mapInPandas(pieces, schema) if by_rows else df.groupBy(bucket).applyInPandas(whole, schema)).persist(level)
    return [held.where(F.col("j") == j).select("bucket", F.col(f"v{j}").alias("value")) for j in range(n)]


def share_of(key: Column, seed: int = 0) -> Column:
    """A number from 0 to below 1 that depends on the key and the seed alone, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def find(weights: Sequence[float], x: Column) -> Column:
    """Number of the weight whose stretch of the running sum holds x (from 0 to 1)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be there and positive")
    total, out = sum(weights), None
    for j, bound in enumerate(list(accumulate(weights))[:-1]):
        out = F.when(x < bound / total, j) if out is None else out.when(x < bound / total, j)
    return F.lit(0) if out is None else out.otherwise(len(weights) - 1)


def weighted_split_sample(df: DataFrame, weights: Sequence[float], key: Column, seed: int = 0, level: StorageLevel = LEVEL) -> list[DataFrame]:
    """Disjoint samples that make up all rows, their chances as the weights; a key always goes the same way."""
    held = df.withColumn("_to", find(weights, share_of(key, seed))).persist(level)
    return [held.where(F.col("_to") == j).drop("_to") for j in range(len(weights))]


def split_sample(df: DataFrame, n: int, key: Column, seed: int = 0, level: StorageLevel = LEVEL) -> list[DataFrame]:
    """n samples of equal chance."""
    if n <= 0:
        raise ValueError("the number of samples must be positive")
    return weighted_split_sample(df, [1.0] * n, key, seed, level)
