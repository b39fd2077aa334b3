"""Near-duplicates by HyperMinHash.

Word shingles are hashed into buckets. A bucket's register stores the count of
leading zeros of its least hash and some mantissa bits after them; a bucket
without a shingle borrows the register of another, by a probe order that is the
same for all documents. Compressed registers are banded. Within a band's key
every set is first compared with the key's central set, the one that shares most
keys with others; sets of one component need no more comparisons. What is left
between components is joined by rare shingles, not by key: two sets as similar as
asked share one of the first shingles of each, rarest first, and at most so far
from its start that enough can follow (prefix and position bounds, both exact).
So a crowded key of sets that are nearly, but not quite, alike makes no pairs.
Pairs go through the size bound and the estimate, corrected for registers that
agree by chance, and are confirmed on the full shingle sets.

Equal shingle sets are one node from the start, so that copies never make pairs.

Defined results: a document with fewer words than a shingle has its whole
sequence as its only shingle; without words, or null, it is linked with nothing.
A component is named by its smallest doc_id (null ids never name one, unless all
are null). Rows that repeat a doc_id are one row each in the result. Other
columns play no part; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from ._common import crowded, doc_key, join_hot, keyed, release, small_batches, stash, unused, without_hot
from ._words import stretches, words_of
from .components import components
from .perfect_hash import mix

REGISTERS, BAND_ROWS, MANTISSA = 256, 6, 10
#: Counters of hashed shingles that order them, rarest first: a table of fixed length. Any order gives the same links.
COUNTERS = 1 << 18
_EMPTY = np.uint16(0xFFFF)
_BOUNDS = np.arange(REGISTERS + 1, dtype=np.uint64)
SETS = "key binary, doc_id long, digest binary, n long, registers binary"
#: Sets that hold a frequent shingle, as far as one task compares them.
GROUP = 1 << 10


def shingles_of(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Distinct hashed word shingles of each text, sorted."""
    for _, data, offsets in stretches(column):
        found = words_of(data, offsets)
        for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True):
            h = found.hashes[a:b]
            n = min(words, len(h))
            if not n:
                yield h
                continue
            out = np.full(len(h) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                out = mix(out ^ h[i : len(h) - n + 1 + i], 1)
            yield np.unique(out)


def _probes() -> np.ndarray:
    """For each bucket the place of every bucket in the order, a permutation of all, in which it asks them for a register."""
    grid = mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64), 77).reshape(REGISTERS, REGISTERS)
    return grid.argsort(axis=1).argsort(axis=1).astype(np.uint8)


_PROBES = _probes()


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of the least hash in each bucket, empty buckets filled."""
    starts = np.searchsorted(shingles, _BOUNDS[:-1] << np.uint64(56))
    ends = np.append(starts[1:], len(shingles))
    full = starts < ends
    low = np.maximum(shingles[starts[full]] & np.uint64((1 << 56) - 1), np.uint64(1))
    exponent = np.frexp(low.astype(np.float64))[1].astype(np.int64)  # bit length
    zeros = 56 - np.minimum(exponent, 56)
    shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (low >> shift) & np.uint64((1 << MANTISSA) - 1)
    out = np.full(REGISTERS, _EMPTY, dtype=np.uint16)
    out[full] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    if not full.all():
        lent = np.flatnonzero(full)
        out[~full] = out[lent[_PROBES[~full][:, lent].argmin(axis=1)]]
    return out


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that the registers of unlike buckets agree: same leading zeros, same mantissa."""
    zeros = np.arange(0, 30)
    above = lambda n, k: -np.expm1(np.maximum(n, 1)[:, None] / REGISTERS * np.log1p(-np.exp2(-np.minimum(k, 50.0)) * (1 - 1e-12)))
    share = lambda n: above(n, zeros.astype(float)) - above(n, zeros + 1.0)
    return (share(n_a) * share(n_b)).sum(axis=1) / (1 << MANTISSA)


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for chance."""
    c = chance(n_a, n_b)
    return np.clip((equal / REGISTERS - c) / (1 - c), 0, 1)


def _sketcher(words: int):
    def sketch(batches):
        import xxhash

        for batch in batches:
            digests, sizes, regs = [], [], []
            for s in shingles_of(batch.column("text"), words):
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())], ["key", "doc_id", "digest", "n", "registers"])

    return sketch


def _bander(batches):
    bands = REGISTERS // BAND_ROWS
    for batch in batches:
        n = batch.num_rows
        regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), dtype=np.uint16).reshape(n, REGISTERS)[:, : bands * BAND_ROWS].reshape(n, bands, BAND_ROWS)
        keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
        for i in range(BAND_ROWS):
            keys = mix(keys ^ regs[:, :, i].astype(np.uint64), 3 + i)
        sid = np.repeat(np.asarray(batch.column("sid")), bands)
        size = np.repeat(np.asarray(batch.column("n")), bands)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(sid), pa.array(size)], ["band", "sid", "n"])


def _estimator(threshold: float):
    def passing(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            n_a, n_b = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            spread = np.sqrt(threshold * (1 - threshold) / np.minimum(REGISTERS, np.minimum(n_a, n_b)))
            good = estimate((a == b).sum(axis=1), n_a, n_b) >= threshold - 5 * spread
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["a", "b"])

    return passing


def _reshingler(words: int, *others: str):
    def shingle(batches):
        for batch in batches:
            hashes = pa.array([s.tobytes() for s in shingles_of(batch.column("text"), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sid", *others)), hashes], ["sid", *others, "hashes"])

    return shingle


def _confirmer(percent: int):
    def confirm(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                p, q = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    return confirm


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _count(batches):
    seen = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for x in batch.column("hashes"):
            np.add.at(seen, _counters(np.frombuffer(x.as_py(), dtype=np.uint64)), 1)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["counter", "seen"])


def _prefixer(seen: np.ndarray, percent: int):
    """The shingles, with their places from the rarest on, by which a set can be found."""

    def prefix(batches):
        for batch in batches:
            out = []
            for sid, component, x in zip(batch.column("sid").to_pylist(), batch.column("component").to_pylist(), batch.column("hashes"), strict=True):
                h = np.frombuffer(x.as_py(), dtype=np.uint64)
                c = seen[_counters(h)]
                order = np.lexsort((h, c))[: len(h) - (percent * len(h) + 99) // 100 + 1]
                place = np.flatnonzero(c[order] > 1)  # a shingle seen once is in no other set
                k = len(place)
                out.append((h[order[place]].view(np.int64), place, np.full(k, sid, np.int64), np.full(k, len(h), np.int64), np.full(k, component, np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["shingle", "place", "sid", "n", "component"])

    return prefix


def _apart(rest: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among rest (sid, component): all that may be links, by prefix and position."""
    texts = _texts(rest, sets, docs).select("sid", "component", "text")
    full = stash(texts.mapInArrow(_reshingler(words, "component"), "sid long, component long, hashes binary"), "rest")
    got = full.select("hashes").mapInArrow(_count, "counter long, seen long").groupBy("counter").agg(F.sum("seen").alias("seen")).toPandas()
    seen = np.zeros(COUNTERS, dtype=np.int32)
    seen[got["counter"].to_numpy(np.int64)] = np.minimum(got["seen"].to_numpy(np.int64), (1 << 31) - 1)
    places = stash(full.mapInArrow(_prefixer(seen, percent), "shingle long, place long, sid long, n long, component long"), "places")
    return _compared(places, percent)


def _compared(places: DataFrame, percent: int, group: int = GROUP) -> DataFrame:
    """Pairs of different components that share a shingle; the sets of a frequent one are dealt into blocks, each a task's."""
    hot = crowded(places, ["shingle"], group)
    even = places if hot is None else without_hot(places, hot, ["shingle"], "times")
    sides = [(even.withColumn("block", F.lit(0)),) * 2]
    if hot is not None:
        many = stash(join_hot(places, hot, ["shingle"], "times").withColumn("blocks", F.ceil(F.col("times") / group).cast("int")), "many")
        dealt = many.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        sides.append((dealt, many.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))))
    met = [_met(*[df.select("shingle", "block", *[F.col(c).alias(f"{c}_{x}") for c in ("place", "sid", "n", "component")]) for x, df in zip("ab", side, strict=True)], percent) for side in sides]
    return (met[0] if len(met) == 1 else met[0].unionByName(met[1])).distinct()


def _met(one: DataFrame, two: DataFrame, percent: int) -> DataFrame:
    enough = lambda x: (100 + percent) * (F.col(f"n_{x}") - F.col(f"place_{x}")) >= percent * (F.col("n_a") + F.col("n_b"))
    # a is the smaller one: of itself alone, it needs fewer places
    one = one.where(f"{100 + percent} * (n_a - place_a) >= {2 * percent} * n_a")
    smaller = F.expr("n_a < n_b or n_a = n_b and sid_a < sid_b")
    fits = (F.col("component_a") != F.col("component_b")) & smaller & (100 * F.col("n_a") >= percent * F.col("n_b")) & enough("a") & enough("b")
    return one.join(two, ["shingle", "block"]).where(fits).select(F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b"))


def _texts(needed: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """needed, unique by sid, with the text of each set's first document; few other texts are shuffled."""
    needed = stash(needed.join(sets.select("sid", F.col("first").alias("key")), "sid"), "needed")
    return bitmaps.among(keyed(docs), needed, ["key"], "wanted").join(needed, "key").dropDuplicates(["sid"])


def _confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sids that are links, written: size bound, estimate, full sets."""
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    wide = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * nb >= {percent} * na and 100 * na >= {percent} * nb")
    likely = stash(wide.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimator(percent / 100), "a long, b long"), "likely")
    texts = _texts(likely.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), sets, docs).select("sid", "text")
    full = stash(texts.mapInArrow(_reshingler(words), "sid long, hashes binary"), "full")
    met = likely.join(full.select(F.col("sid").alias("a"), F.col("hashes").alias("ha")), "a").join(full.select(F.col("sid").alias("b"), F.col("hashes").alias("hb")), "b")
    links = stash(met.select("a", "b", "ha", "hb").mapInArrow(_confirmer(percent), "a long, b long"), "links")
    release(likely, full)
    return links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    small_batches(spark)
    sketched = stash(keyed(docs).mapInArrow(_sketcher(words), SETS), "sketches")
    sets = sketched.where("digest is not null").groupBy("digest").agg(F.first("n").alias("n"), F.first("registers").alias("registers"), F.min("key").alias("first"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    sets = stash(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
    wide, sketched = sketched, stash(sketched.select("key", "doc_id", "digest", "n"), "documents")
    release(wide)
    bands = stash(sets.select("sid", "n", "registers").mapInArrow(_bander, "band long, sid long, n long").select("band", "sid"), "bands")
    # a band holds one row of a set, so that even a third of all sets is less than a hundredth of these rows
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = stash(bands.join(shared, "band"), "members")
    release(bands)
    # the central set of a key is the one that meets most others, over all its keys
    central = members.groupBy("sid").agg(F.sum("members").alias("meets"))
    met = stash(members.drop("members").join(central, "sid"), "met")
    hubs = met.groupBy("band").agg(F.max(F.struct("meets", "sid"))["sid"].alias("hub"))
    pair = [F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")]
    tried = stash(met.join(hubs, "band").where("sid <> hub").select(*pair).distinct(), "tried")
    release(members)
    links = _confirmed(tried, sets, docs, words, percent)
    found = components(links)
    inside = met.select("band", "sid").join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    inside = stash(inside, "inside")
    mixed = inside.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    rest = stash(inside.join(mixed, "band").select("sid", "component").distinct(), "apart")
    release(met, inside)
    if rest.head(1):
        pairs = stash(_apart(rest, sets, docs, words, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
        more = _confirmed(pairs, sets, docs, words, percent)
        found = components(links.unionByName(more)) if more.head(1) else found
    named = sets.select("digest", "sid", "least_id", "copies").join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    named = stash(named, "named")
    names = stash(named.groupBy("component").agg(F.count(F.lit(1)).alias("times"), F.min("least_id").alias("component_id")), "names")
    of_set = stash(join_hot(named, names, ["component"], "times").select("digest", "copies", "component_id"), "of_set")
    of_doc = join_hot(sketched.where("digest is not null").select("key", "doc_id", "n", "digest"), of_set, ["digest"], "copies").select("key", "doc_id", "n", "component_id")
    out = of_doc.unionByName(sketched.where("digest is null").select("key", "doc_id", "n", F.col("doc_id").alias("component_id")))
    out = out.select("key", "doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the first document of each component, all columns kept; rows alike in id and text stay or go together."""
    found = stash(near_duplicates(docs, words, percent).groupBy("key").agg(F.max("kept").alias("kept")), "found")
    key, hit, verdict = unused(docs, "key", "hit", "verdict")
    gone, others = (found.where(c).select(F.col("key").alias(key)) for c in ("not kept", "kept"))
    return bitmaps.outside(docs.withColumn(key, doc_key(docs["doc_id"], docs["text"])), gone, others, [key], [hit, verdict]).drop(key)


def op9_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4).drop("key")
