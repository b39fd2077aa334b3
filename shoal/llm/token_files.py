"""Token ids in binary shards with a minimal perfect hash index.

A shard is two files. NAME.ids holds raw little-endian ids and nothing else,
two bytes each where the vocabulary allows it, four otherwise. NAME.idx maps a
document key through a minimal perfect hash to a stored fingerprint and to the
offset and length of its ids, so that a keyed read takes constant time.

Defined results: null text is empty and has the end id alone; a null doc_id
comes before all others; the key is the doc_id and its ordinal among rows that
repeat it, so that repeated rows are kept apart. Empty input writes nothing.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._bpe import coder_of, crc
from ._common import scratch, small_batches, stash
from .perfect_hash import PerfectHash, fingerprint, mix

MANIFEST = "shard long, name string, n_docs long, n_ids long"
NULL_ID = np.iinfo(np.int64).min


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def keys_of(doc_ids: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    return mix(mix(doc_ids.astype(np.int64).view(np.uint64)) + ordinals.astype(np.uint64), 7)


def ordinals_of(doc_ids: np.ndarray) -> np.ndarray:
    """The ordinal of each id among its equals, ids being sorted."""
    at = np.arange(len(doc_ids))
    starts = np.concatenate(([True], doc_ids[1:] != doc_ids[:-1])) if len(doc_ids) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(starts, at, 0)) if len(doc_ids) else at


def pack_index(doc_ids, offsets, lengths, width: int) -> bytes:
    keys = keys_of(doc_ids, ordinals_of(doc_ids))
    table = PerfectHash.build(keys)
    slots = table.slots(keys)
    place = lambda x, kind: (lambda out: (out.__setitem__(slots, x), out)[1])(np.zeros(len(keys), dtype=kind))
    out = io.BytesIO()
    np.savez(out, width=width, hash=np.frombuffer(table.dump(), dtype=np.uint8), marks=place(fingerprint(keys), np.uint32), offsets=place(offsets, np.int64), lengths=place(lengths, np.int64), doc_ids=doc_ids)
    return out.getvalue()


class Shard:
    """Constant-time keyed access to the ids of one shard."""

    def __init__(self, folder: str, name: str):
        files, path = _open(folder)
        with files.open_input_stream(f"{path}/{name}.idx") as f, np.load(io.BytesIO(f.read())) as z:
            self.table = PerfectHash.load(z["hash"].tobytes())
            self.width, self.marks, self.offsets, self.lengths, self.doc_ids = int(z["width"]), z["marks"], z["offsets"], z["lengths"], z["doc_ids"]
        with files.open_input_stream(f"{path}/{name}.ids") as f:
            self.ids = np.frombuffer(f.read(), dtype=f"<u{self.width}")

    def find(self, doc_ids: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the fingerprint denies it."""
        keys = keys_of(doc_ids, ordinals)
        slots = self.table.slots(keys)
        good = slots >= 0
        good[good] = self.marks[slots[good]] == fingerprint(keys[good])
        return np.where(good, slots, -1)

    def get(self, doc_id: int, ordinal: int = 0) -> np.ndarray | None:
        slot = int(self.find(np.array([doc_id]), np.array([ordinal]))[0])
        return None if slot < 0 else self.ids[self.offsets[slot] : self.offsets[slot] + self.lengths[slot]]


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches):
        coder, files = coder_of(tokenizer), None
        width = 2 if max(coder.vocabulary, end_id + 1) <= 1 << 16 else 4
        end = np.asarray([end_id], dtype="<u4")
        doc_ids, lengths, name, sink = [], [], f"shard-{uuid.uuid4().hex}", None
        for batch in batches:
            if sink is None:
                files, path = _open(folder)
                files.create_dir(path, recursive=True)
                sink = files.open_output_stream(f"{path}/{name}.ids")
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode_all(batch.column("text")), strict=True):
                ids = np.concatenate((ids, end))
                sink.write(ids.astype(f"<u{width}").tobytes())
                doc_ids.append(NULL_ID if doc_id is None else doc_id)
                lengths.append(len(ids))
        if sink is None:
            return
        sink.close()
        n = np.asarray(lengths, dtype=np.int64)
        with files.open_output_stream(f"{path}/{name}.idx") as f:
            f.write(pack_index(np.asarray(doc_ids, dtype=np.int64), np.cumsum(n) - n, n, width))
        yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "name": [name], "n_docs": [len(n)], "n_ids": [int(n.sum())]})

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs in ascending id order as shards below folder; the manifest, one row per shard with its first id's place."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stash(rows.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def _reader(folder: str):
    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(folder, name)
                slots = shard.find(shard.doc_ids, ordinals_of(shard.doc_ids))
                if (slots < 0).any():
                    raise ValueError(f"{name}: a key isn't in its index")
                offsets, lengths = shard.offsets[slots], shard.lengths[slots]
                crcs = [crc(shard.ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(offsets, lengths, strict=True)]
                ids = pa.array(shard.doc_ids, mask=shard.doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays([ids, pa.array(offsets + base), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, each found by its key through the index."""
    shards = manifest.select("name", "base").repartition("name")
    return shards.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark, sf_dir, tokenizer: str | None = None):
    import public_tokenizers

    folder = scratch(spark) + "/tokens"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), 2), folder)
