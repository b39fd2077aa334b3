"""Substring dedup by sliding sentence spans.

A text is cut into sentences at . ! ? and line ends; a sentence of more than
LONG words is cut on after every word whose hash is the least of some NEAR
consecutive words of it. These places depend on the words alone, so a passage that
repeats inside long sentences is cut alike but for NEAR - 1 words at its ends, and
one of over 50 words holds a whole run. From every sentence the run of consecutive sentences that has at
least RUN sentences and WORDS words is hashed. Hashes are joined globally; of a
repeated span the first occurrence (smallest doc_id, then position) stays, and
sentences covered by any other occurrence are removed.

Defined results: sentences compare without the white space around them and with
inner ASCII white space made one blank; a null text is empty and has none; null
doc_ids come last; rows alike in doc_id and text are one document, whose result
is repeated; other columns play no part. Empty input gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crowded, release, small_batches, stash

RUN, WORDS, LONG, NEAR = 3, 24, 12, 7
#: Occurrences of a span that one task takes.
GROUP = 1 << 13
SPANS = "one long, two long, id long, hash long, place long"
#: Bits of a place for the number of sentences of a run.
_SIZE = 24
#: Of either half of a hash: what a run's sentences are weighted by, and its inverse modulo 2^64.
_BASES = [(b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+[\x20\x09-\x0D]*|[^.!?\n]+")
_WORD = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def cuts(words: list[str]) -> list[int]:
    """Places after the words of least hash among NEAR consecutive ones, the last of equals."""
    h = [zlib.crc32(w.encode("utf-8", "surrogatepass").strip()) for w in words]
    out, low = [], 0
    for i in range(len(h)):
        if h[i] <= h[low]:
            low = i
        elif i - low >= NEAR:
            low = min(range(i, i - NEAR, -1), key=h.__getitem__)
        if i >= NEAR - 1 and (not out or out[-1] != low + 1):
            out.append(low + 1)
    return out


def sentences(text: str) -> list[str]:
    """Consecutive parts of text; together they are the text."""
    out = []
    for sentence in _SENTENCE.findall(text):
        words = _WORD.findall(sentence) if len(sentence) > 2 * LONG else []
        if len(words) <= LONG:
            out.append(sentence)
            continue
        places = cuts(words)
        out += ["".join(words[a:b]) for a, b in zip([0, *places], [*places, len(words)], strict=True) if a < b]
    return out


def runs(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of sentences and hash (two numbers) of the run from each sentence that has one."""
    import xxhash

    words = [p.encode("utf-8", "surrogatepass").split() for p in parts]
    full = np.flatnonzero([bool(w) for w in words])  # white space alone is no sentence
    if not len(full):
        return full, full, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(b" ".join(words[i])) for i in full]), dtype=np.uint64).reshape(-1, 2)
    n = np.cumsum([0, *[len(words[i]) for i in full]])
    need = np.searchsorted(n, n[:-1] + WORDS)  # sentences up to the one that completes the words
    ends = np.maximum(need, np.arange(len(full)) + RUN)
    good = ends <= len(full)
    starts, ends = np.arange(len(full))[good], ends[good]
    out = []
    for half, (base, inverse) in zip(digests.T, _BASES, strict=True):
        up, down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(half), x, dtype=np.uint64)))) for x in (base, inverse))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(half * up[:-1])))
        out.append((sums[ends] - sums[starts]) * down[starts])  # each run's first sentence counts once
    return full[starts], full[ends - 1] - full[starts] + 1, *out


def _spanner(batches):
    for batch in batches:
        found = [runs(sentences(text.as_py())) for text in batch.column("text")]
        if not found:
            continue
        at, size, one, two = (np.concatenate(x) for x in zip(*found, strict=True))
        of = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
        place = at.astype(np.int64) << _SIZE | size
        yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column("id").take(of), batch.column("hash").take(of), pa.array(place)], ["one", "two", "id", "hash", "place"])


def _with_firsts(batches, keys: int):
    """Rows of integers in order, each with whether it is the first of its keys or that one's equal."""
    held = None
    for batch in batches:
        x = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        if not len(x):
            continue
        rows = x if held is None else np.concatenate((held[None], x))
        new = np.concatenate(([True], (rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)))
        at = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        held = rows[at[-1]]
        yield x, (rows[:, keys:] == rows[at, keys:]).all(axis=1)[len(rows) - len(x) :]


def _not_first(batches):
    """The occurrences, in the order of their spans, that are not a span's first."""
    for x, first in _with_firsts(batches, 2):
        yield pa.RecordBatch.from_arrays([pa.array(x[~first, c]) for c in (2, 3, 4)], ["id", "hash", "place"])


def _told(batches):
    """The occurrences, in the order of their spans and shares, that are not the first of a share, and the firsts of shares of hot spans."""
    for x, first in _with_firsts(batches, 3):
        use = ~first | (x[:, 2] >= 0)
        yield pa.RecordBatch.from_arrays([*[pa.array(x[use, c]) for c in (0, 1, 3, 4, 5)], pa.array(first[use])], ["one", "two", "id", "hash", "place", "first"])


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, doc_id, text): the id, null last, and a hash of the text tell documents apart and order them."""
    doc_id, text = docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit(""))
    return docs.select(F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text, docs[text_col].isNull(), doc_id.isNull()).alias("hash"), doc_id.alias("doc_id"), text.alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(id, hash, place): the non-first occurrences of repeated spans, written; a place is a sentence's number and the sentences from it.

    Spans are shuffled once, by their hash of 128 bits. Those of more than group
    occurrences are dealt into shares, whose firsts are compared after that.
    """
    small_batches(docs.sparkSession)
    columns = ["id", "hash", "place"]
    spans = stash(_located(docs, id_col, text_col).select("id", "hash", "text").mapInArrow(_spanner, SPANS), "spans")
    hot = crowded(spans, ["one", "two"], group)
    rows = spans.withColumn("times", F.lit(None).cast("long")) if hot is None else spans.join(F.broadcast(hot), ["one", "two"], "left")
    dealt = F.pmod(F.xxhash64(*columns), F.ceil(F.col("times") / group))
    rows = rows.select("one", "two", F.when(F.col("times").isNull(), F.lit(-1)).otherwise(dealt).cast("long").alias("share"), *columns)
    rows = rows.repartition("one", "two", "share").sortWithinPartitions("one", "two", "share", *columns)
    told = stash(rows.mapInArrow(_told, "one long, two long, id long, hash long, place long, first boolean"), "told")
    found = told.where("not first").select(*columns)
    if hot is not None:
        firsts = told.where("first").drop("first").repartition("one", "two").sortWithinPartitions(*spans.columns)
        found = found.unionByName(firsts.mapInArrow(_not_first, "id long, hash long, place long"))
    found = stash(found, "repeated")
    release(spans)
    return found


def _cutter(batches):
    for batch in batches:
        out = []
        for doc_id, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("places"), strict=True):
            parts = sentences(text)
            gone = np.zeros(len(parts) + 1, dtype=np.int64)
            if places.is_valid:
                place = places.values.to_numpy(zero_copy_only=False)
                np.add.at(gone, place >> _SIZE, 1)
                np.add.at(gone, (place >> _SIZE) + (place & (1 << _SIZE) - 1), -1)
            cover = np.cumsum(gone)[:-1] > 0
            kept = "".join(p for p, c in zip(parts, cover, strict=True) if not c)
            n_spans = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum()) if len(cover) else 0
            out.append((doc_id, kept, len(parts), int(cover.sum()), n_spans, len(text) - len(kept)))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "kept_text", "n_sentences", "n_removed", "n_spans", "n_chars_removed"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, kept_text, n_sentences, n_removed, n_spans, n_chars_removed."""
    marks = repeated_spans(docs, id_col, text_col, group).groupBy("id", "hash").agg(F.collect_set("place").alias("places"))  # at most one for each sentence of a document
    joined = _located(docs, id_col, text_col).join(marks, ["id", "hash"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(_cutter, "doc_id long, kept_text string, n_sentences long, n_removed long, n_spans long, n_chars_removed long")


def op8_sentence_spans(spark, sf_dir):
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_sentences", "n_removed", "n_spans", "n_chars_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
