"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and normalisation rule here.
ASCII_SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """URI of a new folder below the shared folder named in spark.checkpoint.dir, which only a local session may leave unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir() + "/shoal-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/shoal-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and return the table read back.

    It cuts lineage, so that a lost executor costs one stage, and every later
    use reads the same rows.
    """
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stashed tables whose readers have all been written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stashed_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], times: str, share: int = 1000) -> DataFrame:
    """left joined with right, a stashed table of one row per key whose column times counts the rows of left.

    Keys of more than one in share of all these rows, fewer than share by
    arithmetic, are broadcast, so that no task is given all rows of a hot key;
    the others are shuffled.
    """
    total = right.agg(F.sum(times)).first()[0] or 0
    hot = F.col(times) * share > total
    few = F.broadcast(right.where(hot))
    rest = left.join(F.broadcast(right.where(hot).select(*on)), on, "left_anti").join(right.where(~hot), on)
    return left.join(few, on).unionByName(rest)


def without_hot(left: DataFrame, right: DataFrame, on: list[str], times: str, share: int = 1000) -> DataFrame:
    """The rows of left whose key isn't in right, a table as join_hot takes it."""
    total = right.agg(F.sum(times)).first()[0] or 0
    hot = F.col(times) * share > total
    return left.join(F.broadcast(right.where(hot).select(*on)), on, "left_anti").join(right.where(~hot).select(*on), on, "left_anti")


def crowded(df: DataFrame, on: list[str], group: int, most: int = 100_000) -> DataFrame | None:
    """on (never null) and times of the keys of more than group rows of df, and of more than one in most of all, stashed; None if there are none.

    By arithmetic they are fewer than most. Rows are counted by a hash of the key
    of about group / 8 rows each first, and exactly only where that is crowded,
    so that no table of all keys is shuffled.
    """
    n = df.count()
    many = max(group, n // most)
    if n <= many:
        return None
    own = df.select(*on, F.pmod(F.xxhash64(*on), F.lit(max(1, 8 * n // many))).alias("bucket"))
    full = stash(own.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > many), "buckets")
    if not full.head(1):
        return None
    # rows of other buckets are one group, so that nothing but crowded keys is counted apart
    own = own.join(F.broadcast(full), "bucket", "left")  # fewer than most buckets
    counts = own.groupBy(*[F.when(F.col("rows").isNotNull(), F.col(c)).alias(c) for c in on]).agg(F.count(F.lit(1)).alias("times"))
    out = stash(counts.where(F.col("times") > many), "crowded").where(F.col(on[0]).isNotNull())
    return out if out.head(1) else None


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like names that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows that an Arrow batch to or from Python holds; a session setting, since plans read it when they run."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return freed memory to the machine at the end of a task, since its Python worker lives on."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def doc_key(doc_id: Column, text: Column) -> Column:
    """Surrogate key of 128 bits: rows alike in both doc_id and text share it, null or not."""
    halves = [F.xxhash64(F.lit(i), doc_id.cast("string"), doc_id.isNull(), F.coalesce(text, F.lit("")), text.isNull()) for i in (1, 2)]
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, text): text null becomes empty; all other columns go."""
    doc_id, text = docs[id_col], docs[text_col]
    return docs.select(doc_key(doc_id, text).alias("key"), doc_id.cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
