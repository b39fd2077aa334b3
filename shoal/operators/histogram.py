"""Counts, histograms, moments and one-row promises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered

def count_by(df: DataFrame, value: Column) -> DataFrame:
    """(value, n)."""
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def hist_by(df: DataFrame, value: Column, normalized: bool = False, cumulative: bool = False) -> DataFrame:
    """(value, freq, place), most frequent first, ties by value.

    Places and running sums take two passes over range partitions, so that no
    task holds all distinct values.
    """
    counts = count_by(df, value)
    out = numbered(counts.select("value", "n", F.struct((-F.col("n")).alias("n"), "value").alias("_order")), "_order", "n")
    freq = F.col("_upto" if cumulative else "n").cast("double")
    if normalized:
        out = out.crossJoin(F.broadcast(out.agg(F.sum("n").alias("_all"))))  # one row
        freq = freq / F.col("_all")
    return out.select("value", freq.alias("freq"), (F.col("_at") + 1).cast("int").alias("place"))


def count_by_flat(df: DataFrame, values: Column) -> DataFrame:
    return count_by(df.select(F.explode(values).alias("_v")), F.col("_v"))


def hist_by_flat(df: DataFrame, values: Column, normalized: bool = False, cumulative: bool = False) -> DataFrame:
    return hist_by(df.select(F.explode(values).alias("_v")), F.col("_v"), normalized, cumulative)


def sample_sink(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """n, mean, least, most, variance and stddev (of the population) of a column; nulls where there is none."""
    v = value.cast("double")
    moments = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("stddev")]
    return df.groupBy(*by).agg(*moments) if by else df.agg(*moments)


def promise(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One lazy row; join it with with_promise."""
    return df.agg(*aggregates)


def promise_of_rows(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """One lazy row by any Python function of all rows, given as an iterator of pandas frames: one task, for frames of bounded size."""
    return df.coalesce(1).mapInPandas(lambda batches: [f(batches)], schema)


def constant_promise(spark, value, name: str = "value") -> DataFrame:
    return spark.range(1).select(F.lit(value).alias(name))


def with_promise(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row with the columns of a promise, which is one row and so is broadcast."""
    return df.crossJoin(F.broadcast(one_row))
