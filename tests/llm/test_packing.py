import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import packing, shared

PATH = shared.public_tokenizer(packing.TOKENIZER)


@pytest.fixture(scope="module")
def enc():
    return packing.WordEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "É", "ß", "İ", "Σ", "ſ", ".", ",", "'s", "'", "<|endoftext|>", " ", "\n", "\u2003", "\u0301", "1", "²", "中", "😀", "\x1c", "\x85", "ﬁ", "ª", "-", "_", "'LL", "ŉ", "Der"]), max_size=14).map("".join))
def test_ids_are_the_librarys(text):
    e = packing.encoder(PATH)
    assert e.ids(text.encode()) == e.whole(text)


def test_remembered_forgets_but_stays_right():
    made = []
    r = shared.Remembered(lambda k: made.append(k) or k * 2, 3)
    for k in [*"abcdefghij", "long" * 99, *"abcdefghij"]:
        assert r[k] == k * 2
    assert len(r) <= 3 and len(r.older) <= 3 and max(map(len, [*r, *r.older])) == 1


def check_pieces(rows, texts, enc, limit=2048):
    """rows against the texts, in any order: every id in one piece, sequences gapless from 0."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for d, own in by_doc.items():
        ids = enc.whole(texts[d] or "") + np.array([1], np.uint32).tobytes()
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    padded = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
        padded += 0 if at & (at - 1) == 0 else limit - at
    return padded


def test_documents(spark, enc):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = packing.pack_documents(docs, PATH, with_ids=True).collect()
    assert check_pieces(rows, {r.doc_id: r.text for r in docs.collect()}, enc) == 0
    assert all(len(r.ids) == r.length for r in rows)


def test_awkward(awkward, nothing, enc):
    docs = awkward.dropDuplicates(["doc_id"])
    rows = packing.pack_documents(docs.withColumn("start", docs.n_chars), PATH).collect()
    assert check_pieces(rows, {r.doc_id: r.text for r in docs.collect()}, enc) == 0
    twice = [r for r in packing.pack_documents(awkward, PATH).collect() if r.doc_id == 8]
    assert len(twice) == 2
    assert packing.pack_documents(nothing, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.floats(0, 1)), max_size=80))
def test_examples_keep_all_limits(items):
    packer = packing.Packer(100, 5, 60, pool=8, cut=False)
    sizes = [(n, min(60, int(n * f))) for n, f in items]
    pieces = [p for i, (n, b) in enumerate(sizes) for p in packer.add(i, n, b)] + list(packer.finish())
    assert sorted(p.example for p in pieces) == list(range(len(sizes)))
    bins = {}
    for p in pieces:
        assert (p.start, p.length) == (0, sizes[p.example][0])
        bins.setdefault(p.bin, []).append(p)
    for own in bins.values():
        assert sum(p.length for p in own) <= 100 and len(own) <= 5 and sum(sizes[p.example][1] for p in own) <= 60


def test_segment_limit_is_kept_with_cuts():
    packer = packing.Packer(64, 3, 64, pool=8)
    pieces = [p for i in range(200) for p in packer.add(i, 1 + i % 50)] + list(packer.finish())
    assert sum(p.length for p in pieces) == sum(1 + i % 50 for i in range(200))
    assert max(sum(1 for p in pieces if p.bin == b) for b in {p.bin for p in pieces}) <= 3


def test_many_tiny_documents_leave_no_padding(spark, enc):
    texts = {i: " ".join("abc"[i % 3] * (i % 4)) if i % 3 else None for i in range(9000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    rows = packing.pack_documents(docs, PATH).collect()
    assert check_pieces(rows, texts, enc) == 0


def test_conversations(spark, enc):
    """The query over whole conversations: sums by brute force, all three limits kept, and bins well filled."""
    from weftline.llm import queries

    d = "/root/testdata/sf0.01"
    want: dict = {}
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        own = want.setdefault(r.conv_id, [0, 0])
        n = len(enc.whole(r.text or "")) // 4 + 1
        own[0] += n
        own[1] += n if r.role == "assistant" else 0
    rows = queries.instruction_packing(spark, d).collect()
    limits = packing.MAX_TOKENS, packing.MAX_SEGMENTS, packing.MAX_LOSS
    fitting = {c: tuple(v) for c, v in want.items() if v[0] <= limits[0] and v[1] <= limits[2]}
    assert {r.example_id: (r.tokens, r.loss_tokens) for r in rows if r.sequence_id is not None} == fitting
    assert {r.example_id for r in rows} == want.keys() and len(rows) == len(want)
    bins: dict = {}
    for r in rows:
        if r.sequence_id is not None:
            bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(o.tokens for o in own[:i]) for i in range(len(own))]
        assert sum(r.tokens for r in own) <= limits[0] and len(own) <= limits[1] and sum(r.loss_tokens for r in own) <= limits[2]
    total = [sum(v[i] for v in fitting.values()) for i in (0, 1)]
    least = max(total[0] / limits[0], total[1] / limits[2], len(fitting) / limits[1])
    assert len(bins) <= 1.1 * least + 8  # a bin may stay open in each partition


def test_pack_examples(spark):
    ex = spark.createDataFrame([(i, 10 + i % 90, i % 10) for i in range(300)] + [(900, None, None), (901, 0, 0)], "example_id long, tokens long, loss_tokens long").repartition(2)
    rows = packing.pack_examples(ex, 128, 8, 20).collect()
    assert sorted(r.example_id for r in rows) == list(range(300))
    rows = packing.pack_examples(ex, 50, 8, 20).collect()  # some are above the limit, and stay without a place
    assert sorted(r.example_id for r in rows) == list(range(300)) and all((r.sequence_id is None) == (r.tokens > 50) for r in rows)
