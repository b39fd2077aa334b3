"""The training-data operators against brute force, on small awkward tables."""

import hashlib
import itertools
import os
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from shoal.llm import bitmaps, exact_dedup, minhash, mixing, packing, perfect_hash, quality, spans, suffix_dedup, token_files, topk, warc
from shoal.llm._bpe import _BYTE_LETTERS, PieceCoder, _Table
from shoal.llm._words import words_of
from shoal.llm.collection_bwt import Folder, transform, unpacked
from shoal.llm.components import components

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, core string"


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeñ"), rng.integers(1, 6))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words, n))
    passage = make(120) + "."
    texts = [make(int(n)) for n in rng.integers(1, 200, 30)]
    texts += [make(40) + ". " + passage + " " + make(30) for _ in range(4)]
    texts += [texts[3], texts[3] + "  ", " ".join(texts[5].split()[:-1] + ["zz"]), "", None, " \n\t", "x", "ab " * 3000, "é" * 900, "a.\n\nb  c  d\n", "<|endoftext|> don't 12,5%%% x_y"]
    texts += ["same line. " * 40, "same line. " * 40, make(30000)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, "k", "c") for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, "no id " + passage, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_words():
    texts = ["Ab  cd\x0bE", "", " ", "ab", "cd" * 9, "e f"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    w = words_of(np.frombuffer(b"".join(data), dtype=np.uint8), offsets)
    got = [w.bounds[i + 1] - w.bounds[i] for i in range(len(texts))]
    assert got == [len(d.split()) for d in data]
    assert w.hashes[0] == w.hashes[3] and len(set(w.hashes.tolist())) == 5


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    for i, t in rows:
        groups["".join(t.encode().decode().translate({ord(c): None for c in " \t\n\v\f\r"}))].append((-len(t), i is None, i))
    want = Counter()
    for text, members in groups.items():
        first = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        want.update((m[2], first[2], len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members)
    got = exact_dedup.copies(docs)
    assert bag(got.select("doc_id", "keep_id", "group_size", "text_sha256").collect()) == want
    assert got.where("kept").count() == len(groups) == exact_dedup.drop_copies(docs).count()
    assert exact_dedup.copies(none).count() == 0 and exact_dedup.drop_copies(none).columns == none.columns


def test_exact_dedup_by_pieces(docs):
    """A filter in several pieces, one bit a row, and columns of other uses with the operator's own names."""
    want = bag(exact_dedup.copies(docs).collect())
    odd = docs.selectExpr("*", "1 as rid", "'x' as text_sha", "true as maybe", "2 as points")
    assert bag(exact_dedup.copies(odd, bits_per_row=4096, piece_bytes=4096).collect()) == want
    assert bag(exact_dedup.copies(docs, bits_per_row=1).collect()) == want
    for options in ({}, {"bits_per_row": 4096, "piece_bytes": 4096}, {"bits_per_row": 1}):
        got = exact_dedup.drop_copies(odd, **options)
        assert got.columns == odd.columns
        assert bag(got.select("doc_id", F.sha2("text", 256)).collect()) == bag(docs.join(exact_dedup.copies(docs).where("kept").dropDuplicates(["doc_id", "n_points", "text_sha256"]).select(F.col("doc_id").alias("i"), "text_sha256", "n_points"), F.col("doc_id").eqNullSafe(F.col("i")) & (exact_dedup.digest(F.col("text")) == F.col("text_sha256")) & (F.length(F.coalesce("text", F.lit(""))) == F.col("n_points"))).dropDuplicates(["doc_id", "text"]).select("doc_id", F.sha2("text", 256)).collect())


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 3)), min_size=1, max_size=4, unique_by=lambda t: t[0]), st.integers(0, 400))
def test_fit_comes_as_near_as_any_choice(lengths, budget):
    l, c = (np.array(x) for x in zip(*lengths, strict=True))
    take = mixing.fit(l, c, budget)
    assert ((take >= 0) & (take <= c)).all()
    best = min(abs(sum(a * n for a, n in zip(l, q, strict=True)) - budget) for q in itertools.product(*[range(n + 1) for n in c]))
    assert abs(int((take * l).sum()) - budget) == best


def test_fit_with_long_documents():
    assert mixing.fit(np.array([45_000, 45_001, 45_002]), np.array([1, 1, 1]), 50_000).tolist() == [0, 0, 1]
    rng = np.random.default_rng(2)
    l = np.unique(rng.integers(1, 10**6, 4000))
    c = rng.integers(1, 50, len(l))
    assert int((mixing.fit(l, c, int((l * c).sum() * 0.4)) * l).sum()) == int((l * c).sum() * 0.4)


def test_targets():
    assert mixing.targets([100, 100, 100]) == [pytest.approx(200), pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([0, 10]) == [0.0, 15.0] and mixing.targets([]) == []


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    sizes = sorted(len((r.text or "").encode().split()) for r in docs.collect())
    assert sorted(r["size"] for r in got) == sizes
    by = defaultdict(list)
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"])
        by[(r.source_size, r.target)].append(r.taken)
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(sizes))
    # whole documents can't come nearer than half the longest one, of 30,000 words here
    assert all(abs(sum(v) - t) <= (15_000 if size > 30_000 else 0.01 * t + 2) for (size, t), v in by.items())
    assert bag(got) == bag(mixing.mix(docs).collect())
    assert mixing.mix(none).count() == 0 and mixing.mixed(docs).columns == docs.columns
    # targets by a rule of their own: pour the budget by weight, a little at a time
    totals = {}
    for r in docs.collect():
        totals[r.source] = totals.get(r.source, 0) + len((r.text or "").encode().split())
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight, given_ = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, dict.fromkeys(order, 0.0)
    left = 1.5 * sum(totals.values())
    while left > 1e-6:
        open_ = [s for s in order if given_[s] < 2 * totals[s] - 1e-9]
        drop = min([left / sum(weight[s] for s in open_)] + [(2 * totals[s] - given_[s]) / weight[s] for s in open_])
        for s in open_:
            given_[s] += drop * weight[s]
        left -= drop * sum(weight[s] for s in open_)
    assert {(r.source_size, round(r.target, 3)) for r in got} == {(totals[s], round(given_[s], 3)) for s in order}


def test_mixed_emits_what_is_taken(spark):
    rows = [(1, "a b c", "s", 7)] * 3 + [(2, "d e f g", "s", 8), (3, "h i", None, 9), (3, "h i", "s", 9), (4, None, "t", 1), (None, "j k l m n", "t", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key int").selectExpr("*", "1 as times", "2 as _key", "3 as _k", "4 as rows", "5 as extra", "6 as mine")
    want = Counter()
    for r in mixing.mix(df).collect():
        if r["size"]:
            want[(r.doc_id, r["size"])] += r.taken // r["size"]
    got = mixing.mixed(df)
    assert got.columns == df.columns and got.where("_key = 2 and _k = 3 and times = 1").count() == got.count()
    assert Counter((r.doc_id, len(r.text.split())) for r in got.collect()) == +want


def test_packing(docs, none):
    coder = PieceCoder(TOKENIZER)
    whole = Counter()
    for r in docs.collect():
        whole[(r.doc_id, zlib.crc32(coder.tokenizer.encode(r.text or "", add_special_tokens=False).ids.__len__().to_bytes(4, "little")))] += 1
    got = packing.pack(docs, TOKENIZER).collect()
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(r.doc_id for r in docs.collect())
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            ids = np.array([*coder.tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], dtype="<u4")
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    lanes = defaultdict(list)
    for r in got:
        lanes[r.sequence_id].append((r.offset, r.length))
    for pieces in lanes.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, TOKENIZER).count() == 0


def test_retrieval_prefers_shared_words():
    bags = [(np.array([1, 2, 3]), np.array([1, 1, 1])), (np.array([7, 8]), np.array([1, 1])), (np.array([2, 3, 9]), np.array([2, 1, 1]))]
    index = packing.Index(bags, np.ones(16, dtype=np.float32), 3.0)
    assert index.neighbours(0, np.array([False, True, True])).tolist() == [2]


def test_retrieval_is_exact_on_documents_of_many_words():
    rng = np.random.default_rng(3)
    bags = []
    for i in range(300):  # each has words of its own, rarer than those that it shares
        common = np.unique(rng.integers(0, 400, int(rng.integers(30, 200))))
        terms = np.concatenate([common, 1000 + 20 * i + np.arange(20)])
        bags.append((terms, rng.integers(1, 5, len(terms))))
    bags += [bags[7], (np.zeros(0, np.int64), np.zeros(0, np.int64))]
    df = np.bincount(np.concatenate([t for t, _ in bags]), minlength=1 << 13)
    idf = np.log1p((len(bags) - df + 0.5) / (df + 0.5))
    mean = float(np.mean([c.sum() for _, c in bags]))
    weights = []
    for t, c in bags:
        norm = packing.K1 * (1 - packing.B + packing.B * c.sum() / mean)
        weights.append(dict(zip(t.tolist(), np.rint(idf[t] * c * (packing.K1 + 1) / (c + norm) * packing.GRAIN), strict=True)))
    index = packing.Index(bags, idf, mean)
    unused = rng.random(len(bags)) < 0.8
    for seed in range(len(bags)):
        scores = [sum(w.get(t, 0.0) for t in weights[seed]) for w in weights]
        want = sorted((-s, j) for j, s in enumerate(scores) if s > 0 and unused[j])[: packing.NEIGHBOURS]
        assert index.neighbours(seed, unused).tolist() == [j for _, j in want]


def test_used_documents_leave_the_index():
    rng = np.random.default_rng(4)
    bags = [(np.unique(rng.integers(0, 300, int(rng.integers(1, 60)))), None) for _ in range(600)]
    bags = [(t, rng.integers(1, 5, len(t))) for t, _ in bags]
    whole, less = (packing.Index(bags, np.linspace(0.5, 3, 300), 30.0) for _ in range(2))
    unused = np.ones(600, dtype=bool)
    for _ in range(4):
        unused &= rng.random(600) < 0.7
        less.keep(unused)
        assert less.held.tolist() == np.flatnonzero(unused).tolist() and len(less.postings) < len(whole.postings)
        for seed in range(0, 600, 7):
            assert less.neighbours(seed, unused).tolist() == whole.neighbours(seed, unused).tolist()
    less.keep(unused & False)
    assert less.neighbours(3, unused).tolist() == []


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(list("ab é\n\t '.1%ñ<|>")), max_size=40))
def test_pieces_encode_as_the_tokenizer_does(text):
    coder = token_coder()
    assert np.frombuffer(coder.encode(text), dtype="<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("abAB é\n\t '.1%ñ<|>\u00a0\u2003\x1c世")), max_size=30), st.lists(st.sampled_from(["ab", "Ab", "don't", "é1", "x.", "%%", "世界"]), max_size=9).map(" ".join), st.lists(st.sampled_from(["ab", "Ab,", "<|endoftext|>"]), max_size=9).map("\n".join)), max_size=8))
def test_columns_encode_as_the_tokenizer_does(texts):
    coder = token_coder()
    got = [ids.tolist() for ids in coder.encode_all(pa.array(texts, pa.string()))]
    assert got == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def new_words(n, letters="abcdefghijklmnopqrstuvwxyzñéß"):
    rng = np.random.default_rng(7)
    return list(dict.fromkeys("".join(rng.choice(list(letters), rng.integers(2, 30))) + ["", ",", ".", "###"][i % 4] for i in range(n)))


def test_new_words_are_merged_together():
    coder, words, calls = PieceCoder(TOKENIZER), new_words(3000), []
    plain, whole = coder.tokenize, coder._whole
    coder.tokenize = lambda x: calls.append(x) or plain(x)
    coder._whole = lambda x: calls.append(x) or whole(x)
    texts = [" ".join(words[:2000]), "\n".join(words[2000:]), words[0], "世界 " + "x" * 90 + " don't a1"]
    got = [ids.tolist() for ids in coder.encode_all(pa.array(texts, pa.string()))]
    assert got == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) < 9


def test_full_tables_keep_words_found_often():
    coder, words = PieceCoder(TOKENIZER), new_words(400)
    coder.table, often = _Table(7), words[:20]
    for a in range(0, 400, 20):
        texts = [" ".join(often + words[a : a + 20] + often[::-1])]
        assert [ids.tolist() for ids in coder.encode_all(pa.array(texts))] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    missing, plain = [], coder._plain
    coder._plain = lambda data, body, starts, *rest: missing.append(len(starts)) or plain(data, body, starts, *rest)
    coder.table.forget()
    assert 0 < coder.table.held <= 32
    list(coder.encode_all(pa.array([" ".join(["x", *often[1:]])])))
    assert sum(missing) <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abcdeghinorstuñé世. ,")), min_size=1, max_size=40), min_size=1, max_size=6))
def test_merges_are_those_of_the_model(words):
    coder = token_coder()
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    at = [(a, b) for a, b in zip((ends - [len(w.encode()) for w in words]).tolist(), ends.tolist(), strict=True) if b - a <= 80]
    ids, lengths = coder.merges.encode(data, np.array([a for a, _ in at], dtype=np.int64), np.array([b for _, b in at], dtype=np.int64))
    letters = [_BYTE_LETTERS.get(b, chr(b)) for b in range(256)]
    want = [[t.id for t in coder.tokenize("".join(letters[x] for x in data[a:b].tolist()))] for a, b in at]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])][: len(at)] == want


def token_coder(held=[]):  # noqa: B006
    if not held:
        held.append(PieceCoder(TOKENIZER))
    return held[0]


def test_perfect_hash():
    keys = perfect_hash.mix(np.arange(5000, dtype=np.uint64))
    table = perfect_hash.PerfectHash.load(perfect_hash.PerfectHash.build(keys).dump())
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    assert len(perfect_hash.PerfectHash.build(keys[:0]).slots(keys[:3])) == 3


def test_token_files(docs, none, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_tokens(docs, folder, TOKENIZER, 2)
    got = token_files.read_tokens(manifest, folder).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at, want = 0, []
    for r in rows:
        ids = np.array([*token_coder().tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    shard = token_files.Shard(folder, manifest.first().name)
    assert shard.get(10**12) is None
    assert token_files.read_tokens(token_files.write_tokens(none, folder + "0", TOKENIZER, 2), folder + "0").count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "x\r\n\r\ny"), (2, None, "x\r\n\r\ny"), (3, "http://a/ b\n", ""), (4, "http://c/", None), (5, "http://d/", "ü"), (5, "http://d/", "ü"), (None, None, "ü"), (None, None, "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(warc.resolve(warc.headers(pages)), f"{tmp_path}/w", 3)
    got = warc.read_archive(spark, f"{tmp_path}/w").collect()
    kinds = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert all(r.block_crc32 == zlib.crc32((dict((i, h or "") for i, _, h in rows if i)[r.page_id]).encode()) for r in got if r.record_type == "response" and r.page_id)
    assert kinds == Counter({(1, "response", None, 6): 1, (2, "revisit", 1, 6): 1, (3, "response", None, 0): 1, (4, "revisit", 3, 0): 1, (5, "response", None, 2): 2, (None, "revisit", 5, 2): 1, (None, "response", None, 4): 1})
    assert all(r.block_bytes == (r.payload_bytes if r.record_type == "response" else 0) for r in got)
    import base64

    assert {r.payload_digest for r in got if r.page_id == 5} == {base64.b32encode(hashlib.sha1("ü".encode()).digest()).decode()}
    warc.write_archive(warc.resolve(warc.headers(pages), 3), f"{tmp_path}/m")
    assert warc.read_archive(spark, f"{tmp_path}/m").where("record_type = 'revisit'").count() == 1
    warc.write_archive(warc.resolve(warc.headers(pages.limit(0))), f"{tmp_path}/e")
    assert warc.read_archive(spark, f"{tmp_path}/e").count() == 0
    by_shuffle = warc.resolve(warc.headers(pages), small_bytes=0)
    columns = ["page_id", "record_type", "refers_to", "payload", "payload_digest"]
    assert bag(by_shuffle.select(columns).collect()) == bag(warc.resolve(warc.headers(pages)).select(columns).collect())


def test_warc_with_awkward_payloads(spark, tmp_path):
    """Line ends at the ends of payloads, long ones, many copies, and columns of other uses with the operator's own names."""
    ends = ["", "\r", "\n", "\r\n", "\r\n\r", "\r\n\r\n", "\n\r\n\r\n\r\n"]
    texts = [a + t + e for a in ends for t in ("abc", "", "WARC/1.1\r\nContent-Length: 3\r\n\r\nx") for e in ends] + ["long \r\n\r\n é" * 100_000]
    rows = [(i, f"http://h/{i}", t, "d", 1, True) for i, t in enumerate(texts + texts[::3] + ["hot"] * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, k int, is_in boolean").repartition(5)
    warc.write_archive(warc.resolve(warc.headers(pages)), f"{tmp_path}/a", 7)
    got = {r.page_id: r for r in warc.read_archive(spark, f"{tmp_path}/a").collect()}
    first = {}
    for i, t in enumerate(r[2] for r in rows):
        r = got.pop(i)
        origin = first.setdefault(t, i)
        assert (r.record_type, r.refers_to, r.payload_bytes) == (("response", None) if origin == i else ("revisit", origin)) + (len(t.encode()),)
        assert r.block_crc32 == zlib.crc32(t.encode() if origin == i else b"")
    assert not got


def test_cascade_is_exact(spark):
    keys = lambda a, b: spark.range(a, b).select(F.col("id").alias("i"), F.lit("x").alias("s"))
    members, others = keys(0, 3000), keys(3000, 50_000)
    assert len(bitmaps.cascade(members, others, ["i", "s"], 3000)) > 1
    rows = keys(0, 50_000).selectExpr("*", "i as hit")
    for small in (bitmaps.SMALL_BYTES, 0):
        got = bitmaps.outside(rows, members, others, ["i", "s"], ["h", "v"], small)
        assert sorted(r.i for r in got.collect()) == list(range(3000, 50_000)) and "v" not in got.columns
    assert bitmaps.outside(rows, members.limit(0), rows, ["i", "s"], ["h", "v"]).count() == 50_000
    likely = bitmaps.among(rows, members, ["i", "s"], "h")
    assert likely.where("i < 3000").count() == 3000 and likely.count() < 6000


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, [None] * 6), (204, [float("nan")] * 6), (250, [0.0] * 6), (None, rows[0][1]), (300, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as q", "2 as block", "'x' as width").repartition(2)
    q = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (6 - len(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for i in sorted(q):
        if i % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    for size, queries in ((32768, 128), (40, 128), (40, 1), (10**6, 2)):
        monkeypatch.setattr(topk, "BLOCK_ROWS", size), monkeypatch.setattr(topk, "BLOCK_QUERIES", queries)
        assert sorted(tuple(r) for r in topk.top_k(df).collect()) == want
    assert topk.top_k(df.limit(0)).count() == 0


def plain_spans(texts: dict[int, str]) -> dict[int, list[int]]:
    """Removed sentence positions by plain comparison of the words of every run."""
    seen, out = {}, {}
    for doc_id in sorted(texts):
        parts = spans.sentences(texts[doc_id])
        words = [(i, p.encode().split()) for i, p in enumerate(parts)]
        words = [(i, w) for i, w in words if w]
        gone = set()
        for s in range(len(words)):
            n, e = 0, s
            while e < len(words) and (n < spans.WORDS or e - s < spans.RUN):
                n, e = n + len(words[e][1]), e + 1
            if n >= spans.WORDS and e - s >= spans.RUN:
                text = hashlib.sha256(b"\0".join(b" ".join(w) for _, w in words[s:e])).hexdigest()
                if text in seen:
                    gone.update(range(words[s][0], words[e - 1][0] + 1))
                seen.setdefault(text, doc_id)
        out[doc_id] = sorted(gone)
    return out


@pytest.mark.parametrize("group", [spans.GROUP, 1])
def test_spans(docs, none, group):
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()}
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = plain_spans(texts)
    got = {r.doc_id: r for r in spans.remove_repeats(unique, group=group).collect()}
    for i, t in texts.items():
        parts = spans.sentences(t)
        assert "".join(parts) == t and got[i].n_removed == len(want[i])
        assert got[i].kept_text == "".join(p for k, p in enumerate(parts) if k not in want[i])
    assert sum(bool(v) for v in want.values()) >= 4
    assert spans.remove_repeats(docs).count() == docs.count() and spans.remove_repeats(none).count() == 0


@pytest.mark.parametrize("ends", ["", ",", ",.", ". "])
def test_passages_are_found_wherever_they_start(ends):
    rng = np.random.default_rng(5)
    make = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    for _ in range(200):
        passage = [w + (str(rng.choice(list(ends))) if ends and rng.random() < 0.15 else "") for w in make(51)]
        texts = {i: " ".join([*make(int(rng.integers(0, 40))), *passage, *make(int(rng.integers(0, 40)))]) for i in range(2)}
        assert plain_spans(texts)[1]
    text = " \t" + "\t".join(make(60))
    assert "".join(spans.sentences(text)) == text and len(spans.sentences(text)) > 1


def naive_components(rows, k):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    name = {r: min([d for d in ds if d is not None], default=None) for r, ds in least.items()}
    return Counter((d, len(sets[i]), name[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, none, k):
    got = minhash.near_duplicates(docs, k)
    assert bag(got.select("doc_id", "n_shingles", "component_id").collect()) == naive_components([(r.doc_id, r.text) for r in docs.collect()], k)
    assert got.where("kept <> (doc_id <=> component_id)").count() == 0
    assert minhash.near_duplicates(none, k).count() == 0


def test_near_duplicates_of_frequent_shingles(docs, monkeypatch):
    monkeypatch.setattr(minhash._compared, "__defaults__", (2,))
    test_near_duplicates_in_a_crowded_key(docs.sparkSession)


def test_drop_near_duplicates_keeps_columns(docs):
    odd = docs.selectExpr("*", "'x' as _key", "1 as hit", "true as verdict")
    want = naive_components([(r.doc_id, r.text) for r in docs.collect()], 5)
    got = minhash.drop_near_duplicates(odd)
    assert got.columns == odd.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(d for (d, _, c), n in want.items() for _ in range(n) if d == c)


def test_near_duplicates_on_chains_and_hot_groups(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    rows = []
    for i in range(120):  # copies that drift: neighbours are alike, ends aren't
        base[rng.integers(0, 120)] = f"d{i}"
        rows.append((i, " ".join(base)))
    common = [f"c{i}" for i in range(30)]
    rows += [(1000 + i, " ".join(common + [f"x{i}-{j}" for j in range(20)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(minhash.near_duplicates(df, 4).select("doc_id", "n_shingles", "component_id").collect()) == naive_components(rows, 4)


def test_near_duplicates_in_a_crowded_key(spark):
    """Texts that are almost as similar as asked share keys, but few are linked; those that are, away from the centre, must be found."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(0, 240, 2):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(1, 12)), replace=False):
            words[at] = f"v{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
        words[int(rng.integers(0, 150))] = "z"
        rows.append((i + 1, " ".join(words[: 150 - int(rng.integers(0, 9))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(minhash.near_duplicates(df, 4).select("doc_id", "n_shingles", "component_id").collect()) == naive_components(rows, 4)


def test_estimate_corrects_for_chance():
    n = np.array([5000])
    assert minhash.estimate(np.array([256]), n, n)[0] == pytest.approx(1.0)
    assert 0 < minhash.chance(n, n)[0] < 1e-2 and minhash.estimate(np.array([0]), n, n)[0] == 0


@pytest.mark.parametrize("more, fewer", [(5, 4), (6, 5), (10, 8)])
def test_small_sets_share_a_band(more, fewer):
    rng = np.random.default_rng(more)
    n = minhash.REGISTERS // minhash.BAND_ROWS * minhash.BAND_ROWS
    missed = 0
    for _ in range(3000):
        h = rng.integers(0, 1 << 64, more, dtype=np.uint64)
        a, b = (minhash.registers(np.sort(x))[:n].reshape(-1, minhash.BAND_ROWS) for x in (h, h[:fewer]))
        missed += not (a == b).all(axis=1).any()
    assert missed == 0
    assert (minhash.registers(h[:1]) == minhash.registers(h[:1])[0]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == got[200] == got[100] == 100


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=7), min_size=1, max_size=6), st.sampled_from([1, 2, 5, 1000]))
def test_collection_transform(strings, block):
    weights = np.array([0, 1, 1, 5], dtype=np.int32)
    with tempfile.TemporaryDirectory() as path:
        blocks = list(transform([np.array(s, dtype=np.uint16) for s in strings], weights, Folder(f"file://{path}/f"), block))
        assert not any(os.scandir(f"{path}/f"))
    assert all(len(b) <= block for b in blocks)
    symbols, prefixes, owner, depth = unpacked(np.concatenate(blocks))
    want = sorted((tuple(s[len(s) - d :]), j, d) for j, s in enumerate(strings) for d in range(len(s) + 1))
    assert [(j, d) for _, j, d in want] == list(zip(owner.tolist(), depth.tolist(), strict=True))
    for k, (suffix, j, d) in enumerate(want):
        assert symbols[k] == (strings[j][len(strings[j]) - d - 1] if d < len(strings[j]) else 0)
        common = 0
        for a, b in zip(suffix, want[k - 1][0] if k else (), strict=False):
            if a != b:
                break
            common += int(weights[a])
        assert prefixes[k] == common


def twice_covered(rows, length):
    """For each (doc_id, bytes) which bytes lie in a string of length bytes that starts twice."""
    windows = Counter(b[p : p + length] for _, b in rows for p in range(len(b) - length + 1))
    for i, b in rows:
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if windows[b[p : p + length]] > 1:
                gone[p : p + length] = True
        yield i, b, gone


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 1])
def test_suffix_dedup(docs, none, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 50 if group == 1 else 1 << 14)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    again = [int(g.sum()) for _, _, g in twice_covered(rows, suffix_dedup.PASSAGE)]
    want = Counter()
    for (i, b, gone), n in zip(twice_covered(rows, 400), again, strict=True):
        spans_ = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        want[(i, len(b), int(gone.sum()), spans_, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), n)] += 1
    got = suffix_dedup.remove_repeats(docs, group=group).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")
    assert bag(got.collect()) == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_of_texts_longer_than_a_stretch(spark):
    rng = np.random.default_rng(8)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    long, shared = letters(1_300_000), letters(700)
    rows = [(1, long[:400_000] + shared + long[400_000:]), (2, letters(150_000) + "!" + shared), (3, letters(1000) + "!" + long[131_072 - 300 : 131_072 + 200]), (4, "ab" * 70_000)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 1200 and got[1].n_spans == 2 and got[2].n_removed == 700 and got[3].n_removed == 500
    assert got[4].n_removed == 140_000 and got[4].n_spans == 1


def junk(spark, n=600):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = " ".join(w + ("%%%" if bad and rng.random() < 0.3 else "") for w in rng.choice(words, rng.integers(5, 80)))
        rows.append((i, text, None, None, None))
        labels += [(i, int(not bad), 0)] * (1 + i % 2)
    docs = spark.createDataFrame([*rows, (10**6, None, None, None, None), (None, "abc", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_learns_on_its_folds_alone(spark):
    docs, labels = junk(spark)
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 != 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and 10**6 in got and None in got
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, flipped)
    assert np.array_equal(model.table, again.table)
    assert quality.train(docs, labels.limit(0)) is None
    assert quality.score(docs.limit(0), None).count() == 0 and quality.score(docs, None).agg(F.min("score")).first()[0] == 1.0


def test_linear_identity():
    m = quality.FactorisationMachine(50, 4, seed=2)
    index, value = np.array([3, 9, 20]), np.array([0.5, 1.0, 2.0])
    pairs = sum(float(m.table[index[i], 1:] @ m.table[index[j], 1:]) * value[i] * value[j] for i in range(3) for j in range(i + 1, 3))
    assert m.raw(index, value) == pytest.approx(m.bias + float(m.table[index, 0] @ value) + pairs, abs=1e-5)


def test_pipeline(spark, tmp_path):
    docs, labels = junk(spark, 200)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
        counts.append(now.select("doc_id", "text").distinct().count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r.doc_id for r in now.collect())
