"""Windowed counts and moments of an event stream with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, value: Column, width: str, late: str) -> DataFrame:
    """(start, value, n) per tumbling window; works on streams and on tables alike."""
    marked = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return marked.groupBy(F.window("_ts", width).alias("w"), value.alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "value", "n")


def windowed_moments(events: DataFrame, ts: str, value: Column, width: str, late: str) -> DataFrame:
    """(start, n, mean, least, most, variance) per tumbling window."""
    v = value.cast("double")
    marked = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    moments = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.var_pop(v).alias("variance")]
    return marked.groupBy(F.window("_ts", width).alias("w")).agg(*moments).select(F.col("w.start").alias("start"), "n", "mean", "least", "most", "variance")
