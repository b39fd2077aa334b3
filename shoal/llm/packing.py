"""Lexical retrieval packing.

Documents are dealt into shards as they are read: a shard closes at SHARD_DOCS
documents or SHARD_BYTES of text, so that its index fits in memory whatever the
input. Each shard has a BM25 inverted index with the document frequencies of
all documents. The document that opens a window is the seed; all its terms are
scored, and the index returns its best unused neighbours, which greedily fill the
window. The one that doesn't fit is cut, and its rest opens the next window as
that window's seed. Only the last sequence of a shard is padded.

Defined results: a null or empty text is its end id alone; repeated rows are
documents of their own; a null doc_id is kept as null. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import coder_of, crc
from ._common import give_back, small_batches
from ._words import stretches, words_of

WINDOW = 2048
#: Hashed lexical terms: the length of the table of document frequencies.
TERMS = 1 << 18
SHARD_DOCS, SHARD_BYTES = 4096, 24 << 20  # documents below 1 << DOC_BITS
#: Neighbours fetched at a time.
NEIGHBOURS = 16
#: A term that more than one in DENSE documents of a shard hold is a row of a table, all others are lists.
DENSE = 8
TOGETHER = 16
#: Bits of a document's number beside its weight; documents from which on an index stays as it is.
DOC_BITS, FEW = 13, 256
K1, B = 1.2, 0.75
#: Weights are whole numbers of 1 / GRAIN, so that sums are exact in any order and equal documents tie.
GRAIN = 1 << 12
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def bags_of(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed lexical terms below size, and their counts, of each text."""
    for _, data, offsets in stretches(column):
        found = words_of(data, offsets)
        texts = np.arange(len(found.bounds), dtype=np.int64) * size
        terms = (found.hashes & np.uint64(size - 1)).astype(np.int64) + np.repeat(texts[:-1], np.diff(found.bounds))
        terms, counts = np.unique(terms, return_counts=True)  # one sort for all texts of a stretch
        cuts = np.searchsorted(terms, texts)
        terms &= size - 1
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield terms[a:b].astype(np.int32), counts[a:b].astype(np.int32)


def _counter(size: int):
    def count(batches):
        df, docs, total = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            for terms, counts in bags_of(batch.column("text"), size):
                df[terms] += 1
                docs, total = docs + 1, total + int(counts.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [docs, total]))], ["term", "n"])

    return count


def statistics(docs: DataFrame, text_col: str = "text", size: int = TERMS) -> tuple[np.ndarray, float]:
    """Inverse document frequencies of all terms (a table of fixed length) and the mean length, over all documents."""
    small_batches(docs.sparkSession)
    got = docs.select(docs[text_col].alias("text")).mapInArrow(_counter(size), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(got["term"], got["n"], strict=True))
    docs_n, total = n.pop(-1, 0), n.pop(-2, 0)
    df = np.zeros(size, dtype=np.float64)
    df[np.fromiter(n.keys(), dtype=np.int64, count=len(n))] = np.fromiter(n.values(), dtype=np.float64, count=len(n))
    return np.log1p((docs_n - df + 0.5) / (df + 0.5)).astype(np.float32), total / max(1, docs_n)


class Index:
    """BM25 inverted index of one shard."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float):
        self.n = len(bags)
        sizes = np.asarray([len(t) for t, _ in bags], dtype=np.int64)
        docs = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        terms = np.concatenate([t for t, _ in bags]) if bags else np.zeros(0, np.int64)
        tf = np.concatenate([c for _, c in bags]).astype(np.float64) if bags else np.zeros(0)
        length = np.asarray([c.sum() for _, c in bags], dtype=np.float64)
        norm = K1 * (1 - B + B * length / max(mean, 1e-9))
        weight = np.rint(idf[terms] * tf * (K1 + 1) / (tf + norm[docs]) * GRAIN)
        order = np.sort(terms.astype(np.int64) << 32 | np.arange(len(terms))) & 0xFFFFFFFF  # by term, then as they come; faster than an argsort
        self.postings, terms = weight[order].astype(np.int64) << DOC_BITS | docs[order], terms[order]  # one look up gives both
        new = np.append(True, terms[1:] != terms[:-1])[: len(terms)]
        number = np.cumsum(new) - 1
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(terms)))
        held = np.empty(len(terms), dtype=np.int64)
        held[order] = number
        self.queries = np.split(held, np.cumsum(sizes)[:-1])
        common = self.sizes * DENSE > self.n
        self.rows = np.where(common, np.cumsum(common) - 1, -1)
        self.table = np.zeros((int(common.sum()), self.n), dtype=np.int32)
        at = common[number]
        self.table[self.rows[number[at]], self.postings[at] & ((1 << DOC_BITS) - 1)] = self.postings[at] >> DOC_BITS
        self.held = np.arange(self.n)
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def keep(self, unused: np.ndarray) -> None:
        """Score none but unused documents from now on; all others can still be seeds."""
        live = unused[self.held]
        docs = self.postings & ((1 << DOC_BITS) - 1)
        stays = live[docs]
        upto = np.append(0, np.cumsum(stays))
        self.starts, ends = upto[self.starts], upto[self.starts + self.sizes]
        self.sizes = ends - self.starts
        self.postings = (self.postings + (np.cumsum(live) - 1 - np.arange(len(live)))[docs])[stays]  # numbered anew
        self.held, self.table, self.last = self.held[live], self.table[:, live], (-1, np.zeros(0))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document held for all terms of the seed."""
        if self.last[0] != seed:
            query = self.queries[seed]
            rows = self.rows[query]
            query = query[rows < 0]
            sizes = self.sizes[query]
            ends = np.cumsum(sizes)
            at = np.repeat(self.starts[query] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
            at = self.postings[at]
            found = np.bincount(at & ((1 << DOC_BITS) - 1), at >> DOC_BITS, minlength=len(self.held)).astype(np.int64)
            rows = rows[rows >= 0]
            for a in range(0, len(rows), TOGETHER):  # sums of int32, each below 2^24, can't overflow
                found += np.add.reduce(self.table[rows[a : a + TOGETHER]], axis=0, dtype=np.int32)
            self.last = (seed, found)
        return self.last[1]

    def neighbours(self, seed: int, unused: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Up to k unused documents that share a term with the seed, best first, ties in order."""
        score = self.scores(seed) * unused[self.held]
        if np.count_nonzero(score) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            best = np.flatnonzero(score >= least)
        else:
            best = np.flatnonzero(score)
        return self.held[best[np.lexsort((best, -score[best]))][:k]]


def order(index: Index, lengths: np.ndarray, window: int) -> list[int]:
    """The order in which a shard's documents fill windows one after the other."""
    unused = np.ones(index.n, dtype=bool)
    out, fill, first, seed, near = [], 0, 0, None, []
    while len(out) < index.n:
        if 4 * (index.n - len(out)) < 3 * len(index.held) and len(index.held) > FEW:
            index.keep(unused)
        chosen = None
        if seed is not None:
            near = [i for i in near if unused[i]] or list(index.neighbours(seed, unused))
            chosen = near[0] if near else None
        if chosen is None:
            while not unused[first]:
                first += 1
            chosen = first
            if seed is None:
                seed = chosen
        unused[chosen] = False
        out.append(int(chosen))
        fill += int(lengths[chosen])
        if fill >= window:
            fill %= window
            seed, near = (int(chosen) if fill else None), []
    return out


def _packer(idf, mean: float, tokenizer: str, end_id: int, window: int):
    def shard(rows, bags, base: int):
        lengths = np.asarray([len(ids) for _, ids in rows], dtype=np.int64)
        out, sequence, fill = [], base, 0
        for i in order(Index(bags, idf, mean), lengths, window):
            doc_id, ids = rows[i]
            at = 0
            while at < len(ids):
                n = min(window - fill, len(ids) - at)
                out.append((doc_id, at, n, crc(ids[at : at + n].tobytes()), len(ids), sequence, fill))
                at, fill = at + n, fill + n
                if fill == window:
                    sequence, fill = sequence + 1, 0
        columns = list(zip(*out, strict=True))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names), sequence + (fill > 0)

    def pack(batches):
        coder, end = coder_of(tokenizer), np.asarray([end_id], dtype="<u4")
        sequence = TaskContext.get().partitionId() << 33
        rows, bags, held = [], [], 0
        for batch in batches:
            column = batch.column("text")
            for doc_id, size, ids, bag in zip(batch.column("doc_id").to_pylist(), pc.binary_length(column).fill_null(0).to_pylist(), coder.encode_all(column), bags_of(column, len(idf)), strict=True):
                rows.append((doc_id, np.concatenate((ids, end))))
                bags.append(bag)
                held += size
                if len(rows) >= SHARD_DOCS or held >= SHARD_BYTES:
                    out, sequence = shard(rows, bags, sequence)
                    yield out
                    rows, bags, held = [], [], 0
        if rows:
            yield shard(rows, bags, sequence)[0]
        rows, bags = [], []
        give_back()

    return pack


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""
    small_batches(docs.sparkSession)
    idf, mean = statistics(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_packer(idf, mean, tokenizer, end_id, window), PIECES)


def op4_packing(spark, sf_dir, tokenizer: str | None = None):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
