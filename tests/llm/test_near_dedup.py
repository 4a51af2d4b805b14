import re

import numpy as np
import pytest

from weftline.llm import components, near_dedup as x


def sets(rows, k):
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute(rows, k):
    """By comparing all pairs that share a shingle."""
    own = sets(rows, k)
    where: dict = {}
    for d, s in own.items():
        for g in s:
            where.setdefault(g, []).append(d)
    parent = {d: d for d in own}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, s in own.items():
        for e in {e for g in s for e in where[g] if e > d}:
            i = len(s & own[e])
            if 100 * i >= 80 * len(s | own[e]):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(own[d]), root(d), root(d) == d) for d in own}


def marks(docs, k):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in x.mark_near_copies(docs, k).collect()}


@pytest.mark.parametrize("k", [4, 5])
def test_documents(spark, k):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    assert marks(docs, k) == brute([(r.doc_id, r.text) for r in docs.collect()], k)


def family(rnd, n, words, edits):
    base = [f"w{rnd.integers(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rnd.integers(0, words, rnd.integers(0, edits + 1)):
            w[at] = f"e{rnd.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def collection(seed):
    """Families of near copies close and loose, pairs, texts of one long passage, and a chain of links."""
    rnd = np.random.default_rng(seed)
    texts = family(rnd, 150, 120, 3) + family(rnd, 60, 200, 12) + [t for _ in range(40) for t in family(rnd, 2, 60, 2)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{rnd.integers(0, 10**6)}" for _ in range(40 + i % 60)) for i in range(80)]
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[i * 4 : 100 + i * 4]) for i in range(25)]
    return list(enumerate(texts))


LIMITS = {
    "as they are": {},
    "nodes branched in a task": {"SMALL": 8},
    "nodes branched as tables": {"SMALL": 4, "WHOLE": 24},
    "groups in parts": {"GROUP": 10, "PARTS": 100},
    "parts of few shingles": {"GROUP_SHINGLES": 600, "PARTS": 1000},
    "large groups": {"GROUP": 10, "PARTS": 2},
    "large groups, small nodes": {"GROUP": 10, "PARTS": 2, "SMALL": 6, "WHOLE": 24, "LEVELS": 3},
}


@pytest.mark.parametrize("limits", LIMITS.values(), ids=LIMITS)
def test_limits(spark, monkeypatch, limits):
    """No limit changes the result."""
    for name, value in limits.items():
        monkeypatch.setattr(x, name, value)
    rows = collection(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert marks(docs, 4) == brute(rows, 4)


def test_template(spark, monkeypatch):
    """Many texts that share 0.7 of their shingles, few of them linked: no group of all pairs is made."""
    monkeypatch.setattr(x, "GROUP", 20)
    monkeypatch.setattr(x, "PARTS", 3)
    monkeypatch.setattr(x, "SMALL", 10)
    rnd = np.random.default_rng(8)
    base = [f"t{i}" for i in range(82)]
    texts = [" ".join(base + [f"u{rnd.integers(0, 10**6)}" for _ in range(18)]) for _ in range(150)]
    texts += [t + " more" for t in texts[:30]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert marks(docs, 5) == brute(rows, 5)


def test_overlaps():
    rnd = np.random.default_rng(9)
    sets = [np.unique(rnd.integers(0, 40, rnd.integers(1, 30))) for _ in range(12)]
    got = x.overlaps(sets)
    assert all(got[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(12) for j in range(i + 1, 12))


def test_repeated_ids(spark):
    """Many rows of one id, or of none: with texts of their own, and all the same."""
    rows = [(7, f"a{i // 2} b{i // 2} c d e f g h") for i in range(40)] + [(None, "x y z") for _ in range(20)] + [(3, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = x.mark_near_copies(docs, 4).collect()
    assert len(got) == 61 and {r.component_id for r in got if r.doc_id is None} == {3} and {r.component_id for r in got if r.doc_id == 7} == {7}


def test_awkward(spark, awkward, nothing):
    once = awkward.dropDuplicates(["doc_id"]).where("doc_id is not null")
    assert marks(once.withColumn("sig", once.lang), 5) == brute([(r.doc_id, r.text) for r in once.collect()], 5)
    got = {(r.doc_id, r.component_id, r.kept) for r in x.mark_near_copies(awkward).collect()}
    assert (None, 1, False) in got and (3, 3, True) in got and (4, 4, True) in got
    kept = x.drop_near_copies(awkward.withColumn("cls", awkward.lang))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 8, 9] and kept.columns == [*awkward.columns, "cls"]
    assert x.mark_near_copies(nothing).count() == 0 and x.drop_near_copies(nothing).count() == 0
    two_nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "g h i j k l"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(r.text for r in x.drop_near_copies(two_nulls).collect()) == ["a b c d e f", "g h i j k l"]


def test_components(spark):
    rnd = np.random.default_rng(5)
    path = [(i, i + 1) for i in range(40)]
    hub = [(1000, 1000 + i) for i in range(1, 60)]
    order = rnd.permutation(41)
    links = [(int(order[a]), int(order[b])) for a, b in path] + hub + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)} | {5000: 5000, 5001: 5000}


def test_estimates():
    rnd = np.random.default_rng(6)
    base = rnd.integers(0, 2**63, 900, dtype=np.uint64)
    errors = []
    for share in (0.5, 0.8, 0.95):
        n = int(900 * share)
        other = np.r_[base[:n], rnd.integers(0, 2**63, 900 - n, dtype=np.uint64)]
        errors.append((x.sketch(base) == x.sketch(other)).mean() - n / (1800 - n))
    assert max(map(abs, errors)) < 0.15
    assert (x.sketch(base[:5000]) == np.minimum(x.sketch(base[:300]), x.sketch(base[300:]))).all()
