import zlib
from collections import Counter

import numpy as np

from weftline.llm import packing, shared, toxicity

from . import test_exact_dedup, test_mixing, test_near_dedup

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


def stage(spark, name, docs):
    return shared.materialize(dict(corpus_pipeline.STAGES)[name](spark, docs, DIR), name)


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    clean = stage(spark, "toxicity", docs)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in toxicity.classify(docs, labels).collect() if not r.predicted}

    single = stage(spark, "exact_dedup", clean)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, v in test_exact_dedup.brute(rows).items() if v[2])

    apart = stage(spark, "near_dedup", single)
    rows = [(r.doc_id, r.text) for r in single.collect()]
    assert sorted(r.doc_id for r in apart.collect()) == sorted(d for d, v in test_near_dedup.brute(rows, 5).items() if v[2])

    mixed = stage(spark, "mixing", apart)
    assert mixed.columns == docs.columns
    plan = {r.doc_id: r.n_copies for r in test_mixing.check(apart)}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in plan.items() if n})

    pieces = stage(spark, "packing", mixed).collect()
    texts = {r.doc_id: r.text for r in apart.collect()}
    enc, copies = packing.encoder(shared.public_tokenizer(packing.TOKENIZER)), Counter(r.doc_id for r in mixed.collect())
    ids = {d: enc.whole(texts[d] or "") + np.array([1], np.uint32).tobytes() for d in copies}
    cover = {d: np.zeros(len(raw) // 4, int) for d, raw in ids.items()}
    sequences = {}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][4 * p.start : 4 * (p.start + p.length)]) and p.doc_tokens == len(cover[p.doc_id])
        cover[p.doc_id][p.start : p.start + p.length] += 1
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all((c == copies[d]).all() for d, c in cover.items())  # each copy's ids, once each
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
