"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length. For each source a whole
number of passes over all its documents is taken first. The remaining budget is
spread over the lengths in proportion, and bounded-knapsack dynamic programming
over the lengths still free fits what is left, from below or from above,
whichever comes nearer. Documents are then selected by the count of their
length, in the order of a seeded hash. Rows are dealt by source, length and 64
slots of that hash; the plan, one row per source, is broadcast.

Defined results: size is the number of words (null or empty text: 0, never
taken more than it has); the null source is a source of its own, after all
others; repeated rows are documents of their own; empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, doc_key, stash, unused

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: Slots into which the documents of one source and length are dealt by their hash.
SLOTS = 64
#: Totals that the dynamic programme tells apart.
CELLS = 1 << 18
#: The plan of one row per source is broadcast: more sources than this are refused.
MAX_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> list[float]:
    """Targets in source order; what a full source can't take is reshared by weight."""
    out = [0.0] * len(sizes)
    free = {i for i, s in enumerate(sizes) if s > 0}
    budget = share * sum(sizes)
    while free:
        total = sum(weights[i % len(weights)] for i in free)
        part = {i: budget * weights[i % len(weights)] / total for i in free}
        over = {i for i in free if part[i] > repeats * sizes[i]}
        if not over:
            for i in free:
                out[i] = part[i]
            return out
        for i in over:
            out[i] = float(repeats * sizes[i])
            budget -= out[i]
        free -= over
    return out


def _programme(lengths: np.ndarray, free: np.ndarray, left: int, seed: int) -> np.ndarray:
    """Bounded knapsack: how many of the free documents of each length come nearest to left.

    Each total that can be reached is held once, with the step that reached it.
    Up to CELLS totals it is exact; beyond, of totals that share a cell of
    left / CELLS words the first is held.
    """
    out = np.zeros_like(lengths)
    some = np.flatnonzero(free)
    unit = int(np.gcd.reduce(lengths[some])) if len(some) else 1
    goal = left - left % unit  # the nearest that can be reached from below
    width = -(-(goal + 1) // CELLS)
    held = np.zeros(goal // width + 1, dtype=bool)
    held[0] = True
    room, n, best = 1024, 1, 0
    sums, parent, step = np.zeros(room, np.int64), np.zeros(room, np.int32), np.zeros(room, np.int32)
    chunks, above = [], None  # above: least total over the goal, its parent, and the documents added
    enough = lambda: sums[best] == goal and (2 * (left - goal) <= unit or above is not None and above[0] == goal + unit)
    for i in np.random.default_rng(seed).permutation(some):
        rest, many = int(free[i]), 1
        while rest > 0 and not enough():
            k = min(many, rest)
            reach = sums[:n] + k * int(lengths[i])
            low = reach <= goal
            if not low.all():
                over = np.where(low, np.iinfo(np.int64).max, reach)
                at = int(np.argmin(over))
                if above is None or over[at] < above[0]:
                    above = int(over[at]), at, (int(i), k)
            if not low.any():
                break
            at = np.flatnonzero(low)
            at = at[~held[reach[at] // width]]
            if width > 1:
                at = at[np.unique(reach[at] // width, return_index=True)[1]]
            if n + len(at) > room:
                room = 2 * (n + len(at))
                sums, parent, step = (np.concatenate((x[:n], np.zeros(room - n, x.dtype))) for x in (sums, parent, step))
            held[reach[at] // width] = True
            sums[n : n + len(at)], parent[n : n + len(at)], step[n : n + len(at)] = reach[at], at, len(chunks)
            if len(at):
                top = n + int(np.argmax(reach[at]))
                best = top if sums[top] > sums[best] else best
            n += len(at)
            chunks.append((int(i), k))
            rest, many = rest - k, 2 * many
        if enough():
            break
    at = best
    if above is not None and above[0] - left < left - int(sums[best]):
        at = above[1]
        i, k = above[2]
        out[i] += k
    while at:
        i, k = chunks[step[at]]
        out[i] += k
        at = int(parent[at])
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    """How many documents of each length to take so that the total comes nearest to budget, from below if both are as near.

    All but one of the documents due to each length in proportion are taken
    first, then, in random order, further ones while more than CELLS words are
    left; the programme fits the rest. Where that isn't exact, and the budget is
    at most CELLS words, the programme fits all of it.
    """
    lengths, counts = lengths.astype(np.int64), np.where(lengths > 0, counts, 0).astype(np.int64)
    total, budget = int((lengths * counts).sum()), max(0, int(budget))
    if total <= budget:
        return counts.copy()
    take = np.maximum((counts.astype(object) * budget // total).astype(np.int64) - 1, 0)
    left = budget - int((take * lengths).sum())
    for i in np.random.default_rng(seed).permutation(len(lengths)):
        if left <= CELLS:
            break
        more = int(min(counts[i] - take[i], (left - CELLS // 2) // lengths[i])) if lengths[i] > 0 else 0
        if more > 0:
            take[i] += more
            left -= more * int(lengths[i])
    take = take + _programme(lengths, counts - take, left, seed)
    if int((take * lengths).sum()) != budget and budget <= CELLS:
        again = _programme(lengths, counts, budget, seed)
        take = min(take, again, key=lambda t: abs(int((t * lengths).sum()) - budget))
    return take


def _fit_source(rows: pa.Table) -> pa.Table:
    """Rows of one source by size: how many documents of each to take beyond the whole passes."""
    rows = rows.sort_by("size")
    target, whole = rows.column("target")[0].as_py(), rows.column("source_size")[0].as_py()
    passes = int(target // whole) if whole else 0
    take = fit(rows.column("size").to_numpy(), rows.column("n").to_numpy(), round(target) - passes * whole)
    columns = [rows.column("skey"), rows.column("size"), pa.array(take, pa.int64()), pa.array([passes] * len(take), pa.int32()), rows.column("source_size"), rows.column("target")]
    return pa.Table.from_arrays(columns, ["skey", "size", "take", "passes", "source_size", "target"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """One row per document: key, doc_id, size, source_size, target, taken."""
    source = docs[source_col].cast("string")
    skey = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source))
    key = _row_key(docs, id_col, text_col, source_col)
    sized = docs.select(key.alias("key"), docs[id_col].cast("long").alias("doc_id"), skey.alias("skey"), words(docs[text_col]).alias("size"), F.xxhash64(key, F.lit(seed)).alias("u"))
    sized = stash(sized.withColumn("slot", F.shiftright(F.col("u"), 58).cast("int")).withColumn("rid", F.monotonically_increasing_id()), "sizes")
    slots = stash(sized.groupBy("skey", "size", "slot").agg(F.count(F.lit(1)).alias("n")), "slots")
    hist = stash(slots.groupBy("skey", "size").agg(F.sum("n").alias("n")), "lengths")
    # one row per source: their number is that of the collections mixed, not of documents
    sources = sorted(hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n"))).collect(), key=lambda r: r[0])
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"{len(sources)} sources are more than {MAX_SOURCES}")
    aims = targets([int(r[1]) for r in sources], weights, share, repeats)
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame([(r[0], int(r[1]), float(t)) for r, t in zip(sources, aims, strict=True)], "skey string, source_size long, target double"))
    # one row per source and length goes to the programme, whatever the number of documents
    due = hist.join(plan, "skey").groupBy("skey").applyInArrow(_fit_source, "skey string, size long, take long, passes int, source_size long, target double")
    before = F.sum("n").over(Window.partitionBy("skey", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))  # at most SLOTS rows
    quotas = slots.withColumn("before", F.coalesce(before, F.lit(0))).join(due, ["skey", "size"])
    quotas = quotas.select("skey", "size", "slot", "passes", "source_size", "target", F.greatest(F.lit(0), F.least("n", F.col("take") - F.col("before"))).alias("quota"))
    order = Window.partitionBy("skey", "size", "slot").orderBy("u", "key", "rid")
    ranked = sized.join(quotas, ["skey", "size", "slot"])
    edge = F.row_number().over(order) <= F.col("quota")
    taken = (F.col("size") * (F.col("passes") + edge.cast("int"))).alias("taken")
    return ranked.select("key", "doc_id", "size", "source_size", "target", taken)


def _row_key(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> Column:
    return doc_key(F.to_json(F.struct(docs[id_col].cast("string").alias("i"), docs[source_col].cast("string").alias("s"))), docs[text_col])


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs, each row as often as the mix takes it; rows alike in id, text and source share what they take, one more for the first ones."""
    key, mine, times, rows, extra = unused(docs, "key", "mine", "times", "rows", "extra")
    shares = mix(docs, id_col, text_col, source_col, **options).where("taken > 0")
    shares = shares.groupBy("key").agg(F.sum((F.col("taken") / F.col("size")).cast("long")).alias("taken_times"))
    shares = shares.select(F.col("key").alias(key), F.col("taken_times").alias(times))
    alike = docs.select(_row_key(docs, id_col, text_col, source_col).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias(rows))
    shares = stash(shares.join(alike, key), "shares")
    out = docs.withColumn(mine, _row_key(docs, id_col, text_col, source_col)).join(shares, F.col(mine) == F.col(key))
    single = out.where(F.col(rows) == 1).withColumn(extra, F.lit(0))
    several = out.where(F.col(rows) > 1).withColumn(extra, (F.row_number().over(Window.partitionBy(mine).orderBy(mine)) <= F.col(times) % F.col(rows)).cast("int"))
    again = lambda df: df.withColumn(times, F.explode(F.expr(f"if({times} div {rows} + {extra} > 0, sequence(1, {times} div {rows} + {extra}), array())")))
    return again(single).unionByName(again(several)).select(*docs.columns)


def op2_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")
