"""Directories of tables, plain CSV lines and packed colours."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_dir(spark: SparkSession, path: str, accept: Callable[[str], bool] = lambda name: True) -> list[str] | None:
    """Paths of the entries of a folder whose names pass, in name order; None if it isn't a folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where) or not files.getFileStatus(where).isDirectory():
        return None
    return sorted(s.getPath().toString() for s in files.listStatus(where) if accept(s.getPath().getName()))


def read_dir(spark: SparkSession, path: str, accept: Callable[[str], bool] = lambda name: True) -> list[str]:
    """list_dir, or nothing."""
    return list_dir(spark, path, accept) or []


def load_all(spark: SparkSession, paths: list[str], repartition: int = 0) -> DataFrame:
    """Positional union of tables; an empty list is an error."""
    if not paths:
        raise ValueError("nothing to load")
    out = functools.reduce(DataFrame.union, [spark.read.load(p) for p in paths])
    return out.repartition(repartition) if repartition > 0 else out


def load_dir(spark: SparkSession, path: str, repartition: int = 0) -> DataFrame:
    """Positional union of every table in a folder, in the default format."""
    return load_all(spark, read_dir(spark, path, lambda name: not name.startswith((".", "_"))), repartition)


load_parquet_dir = load_dir


def csv_line(*columns: Column) -> Column:
    """Fields joined by commas without quoting; null prints as null."""
    return F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])


def _byte(part: Column) -> Column:
    return (part * 255).cast("int")


def rgb(red: Column, green: Column, blue: Column) -> Column:
    """Components from 0 to 1 as one number of 24 bits."""
    return F.shiftleft(_byte(red), 16).bitwiseOR(F.shiftleft(_byte(green), 8)).bitwiseOR(_byte(blue))


def argb(alpha: Column, red: Column, green: Column, blue: Column) -> Column:
    return F.shiftleft(_byte(alpha), 24).bitwiseOR(rgb(red, green, blue))


def grayscale(value: Column, inverse: bool = False) -> Column:
    value = F.lit(1.0) - value if inverse else value
    return rgb(value, value, value)
