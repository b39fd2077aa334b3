"""Natural joins, vectors from columns, and one-pass splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on all columns of equal name: common columns, left's others, right's others.

    Without a common column the result is empty, with the columns of both.
    """
    common = [c for c in left.columns if c in set(right.columns)]
    return left.join(right, common, "inner") if common else left.crossJoin(right).where(F.lit(False))


def cross_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of two small frames."""
    return left.crossJoin(right)


def doubles(*columns: Column | str) -> Column:
    """Columns as an array of doubles in the order given."""
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])


def dense_vectors(df: DataFrame, *columns: Column | str, name: str = "features") -> DataFrame:
    """One vector per row; a null component is an error, as no vector can hold it."""
    values = doubles(*columns)
    return df.select(array_to_vector(F.when(F.forall(values, lambda x: x.isNotNull()), values).otherwise(F.raise_error(F.lit("null in a vector")))).alias(name))


def labeled_points(df: DataFrame, label: Column | str, *columns: Column | str) -> DataFrame:
    """(label double, features vector)."""
    return df.select((F.col(label) if isinstance(label, str) else label).cast("double").alias("label"), array_to_vector(doubles(*columns)).alias("features"))


def split_filter(df: DataFrame, predicate: Column, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> tuple[DataFrame, DataFrame]:
    """Rows where predicate holds, and all others (null counts as false); it is computed once."""
    held = df.withColumn("_holds", F.coalesce(predicate, F.lit(False))).persist(level)
    return held.where("_holds").drop("_holds"), held.where("not _holds").drop("_holds")


def split_either(df: DataFrame, is_left: Column, left: Column, right: Column, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> tuple[DataFrame, DataFrame]:
    """(values of left where is_left, values of right elsewhere)."""
    side = F.coalesce(is_left, F.lit(False))
    held = df.select(side.alias("_left"), F.when(side, left).alias("l"), F.when(~side, right).alias("r")).persist(level)
    return held.where("_left").select(F.col("l").alias("value")), held.where("not _left").select(F.col("r").alias("value"))


def at_most(name: str, threshold: float) -> tuple[Column, str]:
    return F.col(name) <= threshold, f"({name} <= {threshold})"


def above(name: str, threshold: float) -> tuple[Column, str]:
    return F.col(name) > threshold, f"({name} > {threshold})"


def among(name: str, values: Sequence) -> tuple[Column, str]:
    return F.col(name).isin(*values), f"({name} in [{','.join(map(str, values))}])"


def not_among(name: str, values: Sequence) -> tuple[Column, str]:
    return ~F.col(name).isin(*values), f"({name} not-in [{','.join(map(str, values))}])"


def default_name(index: int) -> str:
    return f"f_{index}"
