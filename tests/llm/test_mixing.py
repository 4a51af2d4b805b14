from collections import Counter

import pytest

from weftline.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """By the loop that the rule describes."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, full = share * sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in full]
        level = (left - sum(most * sizes[s] for s in full)) / sum(w[s] for s in free) if free else 0
        out = {s: most * sizes[s] if s in full else w[s] * level for s in names}
        above = {s for s in free if out[s] > most * sizes[s] + 1e-9}
        if not above:
            return out
        full |= above


def check(docs):
    rows = mixing.mix_report(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want = targets(sizes)
    taken, largest = Counter(), Counter()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + sizes[s] * 2e-6
    return rows


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = check(docs)
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.n_copies for r in rows if r.n_copies})


def test_awkward(awkward, nothing):
    check(awkward)
    out = mixing.mix(awkward.withColumn("copies", awkward.lang).withColumn("draw", awkward.lang))
    assert out.columns[-2:] == ["copies", "draw"] and out.count() > 0
    assert mixing.mix_report(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_empty_texts_only(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix_report(docs).collect()] == [(0.0, 0), (0.0, 0)]


def test_emits_what_the_rate_says(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    rows = check(docs)
    assert {r.n_copies for r in rows if r.source == "a"} == {2}


def test_rows_without_ids_or_with_one_id(spark):
    """They are drawn each for itself, so the targets are met."""
    rows = [(None if i % 2 else 7, f"{i} " + "w " * (1 + i % 7), "abc"[i % 3]) for i in range(900)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
