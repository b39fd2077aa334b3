"""Operators on rows in the order of a unique key.

Order is data here: every operator takes the key. A global position or prefix is
computed in two passes over range partitions (each partition's own, then the sum
of those before it), never by a window that puts all rows into one task.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.tables import stash

#: For each prefix operation: aggregate, and how a partition's prefix meets what comes before.
_OPS = {
    "sum": (F.sum, lambda a, b: a + b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "count": (F.count, lambda a, b: a + b),
}


def _ranged(df: DataFrame, order_by: str) -> DataFrame:
    return stash(df.repartitionByRange(order_by).withColumn("_part", F.spark_partition_id()))


def with_ordinal(df: DataFrame, order_by: str, name: str = "ordinal") -> DataFrame:
    """Position of each row from 0 in the order of a key."""
    rows = _ranged(df, order_by)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part").orderBy(order_by)
    return rows.withColumn("_own", F.row_number().over(own)).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def numbered(df: DataFrame, order_by: str, value: str) -> DataFrame:
    """df with _at, the position of each row from 0 in the order of a key, and _upto, the sum of value up to it."""
    rows = _ranged(df, order_by)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum"))
    parts = parts.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_sum")])
    own = Window.partitionBy("_part").orderBy(order_by)
    local = rows.withColumn("_own", F.row_number().over(own)).withColumn("_own_sum", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    joined = local.join(F.broadcast(parts), "_part")
    return joined.withColumn("_at", F.col("_n") + F.col("_own") - 1).withColumn("_upto", F.col("_sum") + F.col("_own_sum")).drop("_part", "_own", "_own_sum", "_n", "_sum")


def drop(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """All but the first n rows."""
    return df if n <= 0 else with_ordinal(df, order_by, "_at").where(F.col("_at") >= n).drop("_at")


def drop_right(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """All but the last n rows."""
    return df if n <= 0 else with_ordinal(df, order_by, "_at").where(F.col("_at") < df.count() - n).drop("_at")


def drop_while(df: DataFrame, predicate: Column, order_by: str) -> DataFrame:
    """Rows from the first on for which predicate doesn't hold."""
    first = df.where(~F.coalesce(predicate, F.lit(False))).agg(F.min(order_by).alias("_first"))
    return df.crossJoin(F.broadcast(first)).where(F.col(order_by) >= F.col("_first")).drop("_first")  # first is one row


def scan(df: DataFrame, value: str, order_by: str, op: str = "sum", name: str = "scanned") -> DataFrame:
    """Prefix sum, min, max or count of a column, this row included."""
    aggregate, combine = _OPS[op]
    rows = _ranged(df, order_by)
    totals = rows.groupBy("_part").agg(aggregate(value).alias("_total"))
    outer = F.sum if op == "count" else aggregate
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_part", outer("_total").over(before).alias("_before"))
    own = Window.partitionBy("_part").orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_own", aggregate(value).over(own)).join(F.broadcast(offsets), "_part")
    both = F.when(F.col("_before").isNull(), F.col("_own")).when(F.col("_own").isNull(), F.col("_before")).otherwise(combine(F.col("_before"), F.col("_own")))
    return local.withColumn(name, both).drop("_part", "_own", "_before")


def scan_left(df: DataFrame, value: str, order_by: str, zero, op: str = "sum") -> DataFrame:
    """(ord, scanned): zero, then zero combined with each prefix; ord counts from 0."""
    rows = with_ordinal(scan(df.select(order_by, value), value, order_by, op), order_by, "_at")
    start = F.lit(zero)
    combine = _OPS[op][1]
    body = rows.select((F.col("_at") + 1).alias("ord"), combine(start, F.col("scanned")).alias("scanned"))
    return df.sparkSession.range(1).select(F.col("id").alias("ord"), start.alias("scanned")).union(body)


def scan_left_with(df: DataFrame, order_by: str, zero, f: Callable, schema: str) -> DataFrame:
    """Prefix scan by any Python function f(state, row): inherently sequential, one task, for frames of bounded size."""

    def run(batches: Iterable):
        import pandas as pd

        state = zero
        yield pd.DataFrame({"ord": [0], "scanned": [state]})
        n = 0
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                state, n = f(state, row), n + 1
                out.append((n, state))
            yield pd.DataFrame(out, columns=["ord", "scanned"])

    return df.coalesce(1).sortWithinPartitions(order_by).mapInPandas(run, schema)


def scan_with(df: DataFrame, value: str, order_by: str, zero, f: Callable, schema: str) -> DataFrame:
    """Prefix scan by an associative Python function f(a, b) with identity zero: two passes over range partitions.

    schema is that of (order_by, scanned); one total per partition comes to the driver.
    """
    rows = _ranged(df.select(order_by, value), order_by)

    def totals(pdf):
        import pandas as pd

        return pd.DataFrame({"_part": [pdf["_part"].iloc[0]], "scanned": [functools.reduce(f, pdf.sort_values(order_by)[value], zero)]})

    kind = schema.split("scanned", 1)[1]
    got = sorted((r["_part"], r["scanned"]) for r in rows.groupBy("_part").applyInPandas(totals, f"_part int, scanned{kind}").collect())
    starts, state = {}, zero
    for part, total in got:
        starts[part] = state
        state = f(state, total)

    def local(pdf):
        import pandas as pd

        pdf, state, out = pdf.sort_values(order_by), starts[pdf["_part"].iloc[0]], []
        for x in pdf[value]:
            state = f(state, x)
            out.append(state)
        return pd.DataFrame({order_by: pdf[order_by].to_numpy(), "scanned": out})

    return rows.groupBy("_part").applyInPandas(local, schema)


def _after(f: Callable, before) -> Callable:
    return lambda pdf: f(pdf, before)


def cascade(df: DataFrame, bucket: str, f: Callable, schema: str) -> DataFrame:
    """Bucket j's rows are f(pandas rows of j, pandas result of j - 1 or None): a chain, one bucket after the other.

    The result of each bucket must be small enough for the driver to pass on.
    """
    spark, before, out = df.sparkSession, None, None
    for (key,) in sorted(df.select(bucket).distinct().collect()):
        now = stash(df.where(F.col(bucket) == key).groupBy(bucket).applyInPandas(_after(f, before), schema))
        before = now.toPandas()
        out = now if out is None else out.union(now)
    return out if out is not None else spark.createDataFrame([], schema)


def paste(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows paired by position; frames of different length are an error."""
    if left.count() != right.count():
        raise ValueError("frames to paste differ in length")
    return with_ordinal(left, left_key, "_at").join(with_ordinal(right, right_key, "_at"), "_at").drop("_at")


def paste_by(left: DataFrame, right: DataFrame, left_key: str, right_key: str, of_left: Column, of_right: Column) -> DataFrame:
    """(a, b): a column of each side's row, paired by position."""
    return paste(left.select(F.col(left_key).alias("_l"), of_left.alias("a")), right.select(F.col(right_key).alias("_r"), of_right.alias("b")), "_l", "_r").select("a", "b")
