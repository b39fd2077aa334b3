"""Substring dedup: every byte covered by a string of LENGTH bytes that starts twice.

Hashes only choose what is looked at; the transform decides what is a repeat.

1. Every window of PASSAGE bytes has an anchor, its least hashed k-gram (the
   leftmost of equals). Equal windows have equal anchors at the same place, so
   that only anchors whose hash occurs twice can hold a repeat. A run is the
   windows of one anchor. One of the runs with equal content stands for all and
   counts as often, so that copies without number are one run to look at.
2. Runs are cut into units at fixed places from the anchor. All windows of a
   unit contain its core, and units with equal cores meet in one task.
3. There they are cut into parts of PART windows, which contain a longer core
   each. Parts whose core occurs twice are strings (bytes before the core, the
   core as one symbol of its own weight, bytes after it), each with its count,
   and go shard by shard through the collection Burrows-Wheeler transform over
   sequential files in the shared folder. A suffix that holds the length asked is
   a repeat if it has that length in common with a neighbour, or counts twice.
   Where more than GROUP units have one core, they are compared window by
   window instead, by digest, and spread over all tasks.
4. Repeats go back to all occurrences, whose covered bytes are removed.

The same is done for strings of PASSAGE bytes, which are counted, not removed;
where LENGTH bytes repeat, those among them need no strings of their own.
Content, cores and windows are told apart by digests of 128 bits.

Defined results: a null text is empty; texts shorter than LENGTH are kept whole;
matches never cross texts; repeated rows are documents of their own and remove
each other; all is judged on the input. Other columns play no part, whatever
their names; empty input gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crowded, join_hot, keyed, release, scratch, small_batches, stash, without_hot
from ._words import powers, stretches
from .collection_bwt import ROW, Folder, transform, unpacked
from .perfect_hash import mix

LENGTH, PASSAGE = 400, 280
#: Bytes of an anchor's k-gram; window starts in a unit, and in a part of it.
GRAM, UNIT, PART = 32, 32, 16
#: Bytes looked at together; strings of a shard; units of a core that go through the transform.
STRETCH, SHARD, GROUP = 1 << 17, 1 << 14, 1 << 13
_TABLE = mix(np.arange(256, dtype=np.uint64), 23)
_POSITION = np.uint64((1 << 20) - 1)
#: Of a run: first window, number of windows and place of the anchor, in one number.
_LO, _N, _FIELD = 24, 12, (1 << 12) - 1
RUNS = "h long, content binary, key binary, place long"
UNITS = "kind short, core binary, content binary, times long, first int, n int, head binary, tail binary"
MARKS = "content binary, mark long, times long"


def _grams(data: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[:-1])))
    n = len(data) - GRAM + 1
    return mix((sums[GRAM:] - sums[:n]) * down[:n], 1)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every stretch of width values."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """(h, lo, n, off) of the runs of windows, none across an offset: anchor hash, first window, windows and anchor's place in it."""
    out = []
    for base in range(0, max(1, len(data) - passage + 1), STRETCH):
        part = data[base : min(len(data), base + STRETCH + passage - 1)]
        if len(part) < passage:
            continue
        grams = _grams(part)
        least = _window_min((grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64), passage - GRAM + 1)
        anchor = (least & _POSITION).astype(np.int64)
        ends = offsets[(offsets > base) & (offsets < base + len(part))] - base
        crossing = np.zeros(len(anchor) + 1, dtype=np.int32)
        np.add.at(crossing, np.minimum(np.maximum(ends - passage + 1, 0), len(anchor)), 1)
        np.add.at(crossing, np.minimum(ends, len(anchor)), -1)
        anchor[np.cumsum(crossing[:-1]) > 0] = -1
        lo = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        n = np.diff(np.append(lo, len(anchor)))
        good = anchor[lo] >= 0
        lo, n = lo[good], n[good]
        out.append((grams[anchor[lo]], lo + base, n, anchor[lo] - lo))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.uint64 if i < 1 else np.int64) for i in range(4))


def _runner(length: int, passage: int):
    def run(batches):
        import xxhash

        for batch in batches:
            keys = batch.column("key")
            for first, data, offsets in stretches(batch.column("text"), STRETCH):
                h, lo, n, off = runs(data, offsets, passage)
                text = np.searchsorted(offsets, lo, "right") - 1
                ends = np.minimum(lo + n - 1 + length, offsets[text + 1])
                body = memoryview(data)
                content = [xxhash.xxh3_128_digest(body[a:b], seed=s) for a, b, s in zip(lo.tolist(), ends.tolist(), (off << 10 | n).tolist(), strict=True)]
                place = (lo - offsets[text]) << _LO | n << _N | off
                columns = [pa.array(h.view(np.int64)), pa.array(content, pa.binary()), keys.take(pa.array(first + text)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["h", "content", "key", "place"])

    return run


def _unit_maker(lengths: tuple[int, int]):
    """Units of each run in a text's list, for windows of either length."""
    kinds = {"kind": pa.int16(), "core": pa.binary(), "content": pa.binary(), "times": pa.int64(), "first": pa.int32(), "n": pa.int32(), "head": pa.binary(), "tail": pa.binary()}

    def make(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for text, marks in zip(batch.column("text"), batch.column("runs"), strict=True):
                body, out = text.as_buffer().to_pybytes(), []
                for r in marks.as_py():
                    content, times, place = r["content"], r["times"], r["place"]
                    first, n = place >> _LO, place >> _N & _FIELD
                    anchor, end = first + (place & _FIELD), first + n
                    for kind, length in enumerate(lengths):
                        hi = min(end, len(body) - length + 1)
                        # windows of the longer kind repeat for certain where the content does
                        lo = max(first, len(body) - lengths[1] + 1) if kind == 0 and times > 1 else first
                        # a unit's starts are anchor + UNIT * i .. anchor + UNIT * i + UNIT - 1
                        for base in range(lo - (lo - anchor) % UNIT, hi, UNIT):
                            s, e = max(lo, base), min(hi, base + UNIT)
                            out.append((kind, digest(body[base + UNIT - 1 : base + length]), content, times, s - first, e - s, body[s : base + UNIT - 1], body[base + length : e - 1 + length]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    return make


class Core:
    """Strings that share a core: (head, tail, windows, count, units and windows where they begin).

    Where there is one string only, all of it is the core, one symbol for all its windows.
    """

    def __init__(self, length: int, group: int, strings: list[tuple[bytes, bytes, int, int, list[tuple[int, int]]]], part: int = PART):
        self.length, self.group = length, group
        self.alone = len(strings) == 1
        self.weight = length + (strings[0][2] - 1 if self.alone else 1 - part)
        self.strings = [(b"", b"", *strings[0][2:])] if self.alone else strings


def parts(units: list[tuple[bytes, bytes, int, int]], length: int, group: int) -> list[Core]:
    """The cores of parts that occur twice. units, all of one core, are (head, tail, number of windows, count)."""
    if len(units) == 1:
        head, tail, n, count = units[0]
        return [Core(length, group, [(head, tail, n, count, [(0, 0)])])] if count > 1 else []
    found: dict[tuple, dict[tuple, list]] = {}
    for u, (head, tail, n, count) in enumerate(units):
        a = UNIT - 1 - len(head)
        for i in range(a // PART, (a + n - 1) // PART + 1):
            low, high = max(a, PART * i), min(a + n, PART * i + PART)
            core = PART * i + PART - 1 - a  # where it begins, in head
            of_core = found.setdefault((i, head[core:], tail[: PART * i]), {})
            string = of_core.setdefault((head[low - a : core], tail[PART * i : high - 1]), [high - low, 0, []])
            string[1] += count
            string[2].append((u, low - a))
    return [Core(length, group, [(h, t, *rest) for (h, t), rest in of_core.items()]) for of_core in found.values() if sum(c for _, c, _ in of_core.values()) > 1]


def covered(cores: list[Core], folder: Folder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, a, b): the windows a to b - 1 occur twice; strings count from the first core's on."""
    weights = np.concatenate((np.ones(257, np.int64), [c.weight for c in cores]))
    flat = [x for c in cores for x in c.strings]
    group = np.repeat(np.arange(len(cores)), [len(c.strings) for c in cores])
    symbols = lambda b: np.frombuffer(b, dtype=np.uint8).astype(np.uint16) + np.uint16(1)
    names = (257 + np.arange(len(cores))).astype(np.uint16)
    strings = [np.concatenate((symbols(x[0]), names[g : g + 1], symbols(x[1]))) if x[0] or x[1] else names[g : g + 1] for g, x in zip(group.tolist(), flat, strict=True)]
    sizes, windows, several = (np.array(x) for x in zip(*[(len(s), x[2], x[3] > 1) for s, x in zip(strings, flat, strict=True)], strict=True))
    need, alone = np.array([c.length for c in cores])[group], np.array([c.alone for c in cores])[group]
    found, last = [], np.zeros(0, ROW)
    for block in transform(strings, weights, folder):
        rows = np.concatenate((last, block))  # the row before a block may repeat its first
        _, prefix, owner, depth = unpacked(rows)
        window = sizes[owner] - depth
        twice = prefix >= need[owner]
        either = several[owner] | twice
        either[:-1] |= twice[1:]
        at = np.flatnonzero(either & (depth > 0) & (window < windows[owner]))
        found.append(owner[at] << 32 | window[at])
        last = rows[-1:]
    at = np.unique(np.concatenate(found))
    starts = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1))) if len(at) else at
    string, a = at[starts] >> 32, at[starts] & 0xFFFFFFFF
    b = (at[np.append(starts[1:], len(at)) - 1] & 0xFFFFFFFF) + 1 if len(at) else at
    return string, a, np.where(alone[string], windows[string], b)


def _mark(kind: int, a: int, b: int) -> int:
    """The windows a to b - 1 of a run, in one number."""
    return kind << 48 | a << 24 | b


def _transformer(lengths: tuple[int, int], shared: str):
    """Whole groups, whose rows follow one another, go through the transform in shards."""

    def flush(groups, cores):
        folder = Folder(f"{shared}/{uuid.uuid4().hex}")
        found = covered(cores, folder)
        folder.remove()
        places = [(c.group, x[4]) for c in cores for x in c.strings]
        out = []
        for i, a, b in zip(*(x.tolist() for x in found), strict=True):
            g, at = places[i]
            kind, uses = groups[g]
            for u, start in at:
                out += [(content, _mark(kind, first + start + a, first + start + b), n) for content, n, first in uses[u]]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["content", "mark", "times"])

    def run(batches):
        groups, cores, held, now, units = [], [], 0, None, {}

        def close():
            """The units of one core, equal ones together, become strings."""
            made = parts([(*unit, sum(n for _, n, _ in uses)) for unit, uses in units.items()], lengths[now[0]], len(groups)) if units else []
            cores.extend(made)
            if made:
                groups.append((now[0], list(units.values())))
            units.clear()
            return sum(len(c.strings) for c in made)

        for batch in batches:
            for kind, core, content, times, first, n, head, tail in zip(*(c.to_pylist() for c in _not_single(batch).columns), strict=True):
                if (kind, core) != now:
                    held += close()
                    if held >= SHARD:
                        yield flush(groups, cores)
                        groups, cores, held = [], [], 0
                    now = kind, core
                units.setdefault((head, tail, n), []).append((content, times, first))
        held += close()
        if held:
            yield flush(groups, cores)

    return run


def _not_single(batch: pa.RecordBatch) -> pa.RecordBatch:
    """batch without the units whose core comes once, as far as the batch shows it."""
    if batch.num_rows < 3:
        return batch
    column = batch.column("core")
    core = np.frombuffer(column.buffers()[2], dtype=np.uint64)[2 * column.offset : 2 * (column.offset + batch.num_rows)].reshape(-1, 2)
    kind = batch.column("kind").to_numpy()
    same = np.append((core[1:] == core[:-1]).all(axis=1) & (kind[1:] == kind[:-1]), True)  # as the next one, which the last can't tell
    keep = same | np.append(True, same[:-1]) | (batch.column("times").to_numpy() > 1)
    return batch if keep.all() else batch.filter(pa.array(keep))


def _windows(lengths: tuple[int, int]):
    """Each window of a unit with its digest."""

    def digests(batches):
        import xxhash

        for batch in batches:
            out = []
            for kind, core, content, times, first, n, head, tail in zip(*(batch.column(c).to_pylist() for c in ("kind", "core", "content", "times", "first", "n", "head", "tail")), strict=True):
                for w in range(n):
                    rest = len(tail) - (n - 1 - w)
                    out.append((xxhash.xxh3_128_digest(b"".join((bytes((kind, len(head) - w)), core, head[w:], tail[:rest]))), content, times, _mark(kind, first + w, first + w + 1)))
            if out:
                kinds = pa.binary(), pa.binary(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["window", "content", "times", "mark"])

    return digests


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE, group: int = GROUP) -> DataFrame:
    """(key, place, marks) of the runs with repeats, written; a mark is the windows of a run (from place >> 24 on) that occur elsewhere too, of passage bytes (kind 0) or of length (1)."""
    spark, lengths = docs.sparkSession, (passage, length)
    small_batches(spark)
    texts = keyed(docs, id_col, text_col)
    found = stash(texts.mapInArrow(_runner(length, passage), RUNS), "runs")
    anchors = stash(found.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "anchors")
    shared = stash(join_hot(found, anchors, ["h"], "times").drop("h", "times"), "shared")
    release(found, anchors)
    contents = shared.groupBy("content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "place")).alias("r"))
    of_text = contents.groupBy(F.col("r.key").alias("k")).agg(F.collect_list(F.struct("content", "times", "r.place")).alias("runs"))  # runs of one text
    units = texts.join(of_text, texts["key"] == of_text["k"]).select("text", "runs")
    units = stash(units.mapInArrow(_unit_maker(lengths), UNITS), "units")
    hot = crowded(units, ["kind", "core"], group)
    few = units if hot is None else without_hot(units, hot, ["kind", "core"], "times")
    few = few.select(*units.columns).repartition("kind", "core").sortWithinPartitions("kind", "core")
    marked = few.mapInArrow(_transformer(lengths, scratch(spark) + "/transform"), MARKS)
    if hot is not None:
        of_hot = join_hot(units, hot.withColumnRenamed("times", "members"), ["kind", "core"], "members")
        windows = stash(of_hot.mapInArrow(_windows(lengths), "window binary, content binary, times long, mark long"), "windows")
        twice = stash(windows.groupBy("window").agg(F.count(F.lit(1)).alias("rows"), F.sum("times").alias("all")).where("all > 1").drop("all"), "twice")
        marked = marked.unionByName(join_hot(windows, twice, ["window"], "rows").select("content", "mark", "times"))
    marks = stash(marked.groupBy("content").agg(F.max("times").alias("times"), F.collect_set("mark").alias("marks")), "marks")  # windows of one run
    release(units)
    placed = stash(join_hot(shared, marks, ["content"], "times").select("key", "place", "marks"), "placed")
    release(shared, marks)
    return placed


def _cutter(length: int, passage: int):
    names = ["key", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept"]

    def cover(size: int, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
        change = np.zeros(size + 1, dtype=np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, ends - 1 + width, -1)
        return np.cumsum(change[:-1]) > 0

    def cut(batches):
        for batch in batches:
            out = []
            for key, doc_id, text, found in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("found"), strict=True):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                gone = again = np.zeros(len(data), dtype=bool)
                if found.is_valid and len(found.values):
                    marks = found.values.field("marks")
                    mark = marks.flatten().to_numpy(zero_copy_only=False)
                    lo = np.repeat(found.values.field("place").to_numpy(zero_copy_only=False) >> _LO, marks.value_lengths().to_numpy(zero_copy_only=False))
                    starts, ends, long = lo + (mark >> 24 & 0xFFFFFF), lo + (mark & 0xFFFFFF), mark >> 48 == 1
                    gone = cover(len(data), starts[long], ends[long], length)
                    again = gone | cover(len(data), starts[~long], ends[~long], passage)
                kept = data[~gone].tobytes()
                n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]) if len(gone) else 0
                out.append((key, doc_id, len(data), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), int(again.sum()), kept))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.binary(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE, group: int = GROUP) -> DataFrame:
    """One row per document: key, doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated, kept (bytes, which may cut a character).

    n_repeated counts the bytes covered by strings of passage bytes that start elsewhere too.
    """
    if not GRAM <= passage <= length or passage <= UNIT or length > _FIELD:
        raise ValueError("passage must hold a gram and a unit, length at least a passage")
    placed = repeats(docs, id_col, text_col, length, passage, group)
    placed = placed.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("place", "marks")).alias("found"))  # runs of one text
    texts = keyed(docs, id_col, text_col)
    joined = texts.join(placed, texts["key"] == F.col("k"), "left").select("key", "doc_id", "text", "found")
    return joined.mapInArrow(_cutter(length, passage), "key binary, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, kept binary")


def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key", "kept")
