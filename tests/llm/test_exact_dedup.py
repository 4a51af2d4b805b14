import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import exact_dedup as x


def brute(rows):
    """doc_id, text -> as the docstring of mark_copies has it, for unique ids."""
    norm = {d: re.sub(r"[\x20\x09-\x0D]", "", t or "") for d, t in rows}
    group = {}
    for d, t in rows:
        group.setdefault(norm[d], []).append((-len(t or ""), d is None, d or 0, d))
    out = {}
    for d, _ in rows:
        g = group[norm[d]]
        keep = min(g)[3]
        out[d] = (keep, len(g), d == keep, hashlib.sha256(norm[d].encode()).hexdigest())
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40).map(lambda i: i * 0x123456789ABCDEF % 2**64), max_size=30), min_size=1, max_size=5), st.integers(0, 5))
def test_filters_merge_without_loss(parts, bits):
    merged: dict = {}
    for p in parts:
        for i, s in x.CountingQuotientFilter.of(np.array(p, np.uint64)).slices(bits):
            s = x.CountingQuotientFilter.from_bytes(s.to_bytes())
            merged[i] = merged[i].merge(s) if i in merged else s
    got = {int(k): int(n) for f in merged.values() for k, n in zip(f.fingerprints(), f.counts)}
    everything = [k for p in parts for k in p]
    assert got == {k: everything.count(k) for k in everything}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in x.mark_copies(docs).collect()}
    assert got == want
    kept = x.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, w in want.items() if w[2])


def test_awkward(awkward, nothing):
    once = awkward.dropDuplicates(["doc_id"])
    want = brute([(r.doc_id, r.text) for r in once.collect()])
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in x.mark_copies(once.withColumn("sha", once.lang)).collect()} == want
    rows = [r for r in x.mark_copies(awkward).collect() if r.doc_id == 8]
    assert [r.group_size for r in rows] == [2, 2] and sorted(r.kept for r in rows) == [False, True]
    kept = x.drop_copies(awkward.withColumn("norm", awkward.lang)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "5", "6", "8", "9"]
    assert x.mark_copies(nothing).count() == 0 and x.drop_copies(nothing).count() == 0


def test_texts_of_one_fingerprint_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(x.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a "), (4, "c")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in x.mark_copies(docs).collect()} == {1: 3, 2: 2, 3: 3, 4: 4}
