import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import boosting, labelled, quality_model, toxicity


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def walk(trees, row):
    """One row through one tree after the other, the plain way."""
    total = trees.base
    for at in trees.roots:
        while trees.left[at] != at:
            at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        total += trees.value[at]
    return total


def test_trees_learn_and_traversal_is_right():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    assert ((trees.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    assert np.allclose(trees.margins(x[:50]), [walk(trees, r) for r in x[:50]])
    assert np.array_equal(trees.margins(x), boosting.fit(x[:2000], y[:2000]).margins(x))


def test_trees_without_rows_or_with_one_class():
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert boosting.fit(np.zeros((9, 3)), np.ones(9)).scores(np.ones((1, 3)))[0] > 0.9
    assert boosting.fit(np.ones((9, 2)), np.array([0, 1] * 4 + [1.0])).scores(np.ones((1, 2)))[0] == pytest.approx(5 / 9, abs=0.01)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 1)), min_size=1, max_size=40))
def test_isotonic_rises_and_keeps_order(pairs):
    s, y = np.array([p[0] for p in pairs]), np.array([float(p[1]) for p in pairs])
    out = boosting.isotonic(s, y)(np.linspace(0, 1, 50))
    assert (np.diff(out) >= -1e-12).all() and out.min() >= 0 and out.max() <= 1


def test_statistics_fit_their_names():
    for t in ["", " \n", "x", "a b\nc. d!", "ü" * 1000, "### $$$"]:
        assert len(quality_model.statistics(t)) == len(quality_model.STATISTICS) and np.isfinite(quality_model.statistics(t)).all()
        assert len(toxicity.Measure(toxicity.Lexicon({"a": (2, 1.0)}))(t)) == len(toxicity.FEATURES)


def test_hidden_words_are_measured():
    m = toxicity.Measure(toxicity.Lexicon({"idiot": (3, 5.0)}))
    hidden = toxicity.FEATURES.index("hidden_strong")
    assert [m(t)[hidden] for t in ("an id1ot", "an i.d.i.o.t here", "i d i o t", "an idea", "an id-iot!")] == [1, 1, 1, 0, 1]
    near = toxicity.FEATURES.index("near_second_person")
    assert m("you are an idiot")[near] == 1 and m("you know that some one else said idiot")[near] == 0


def plain_hidden(low):
    """By trying every end of every token."""
    for token in re.findall(r"\S+", low):
        for end in range(len(token), 0, -1):
            if re.fullmatch(r"[^\W\d_][^\W_]*[013457@$!|.\-_*'+]\S*[^\W\d_]", token[:end]) and not re.match(r"\w", token[end:]):
                yield token[:end]
                break


@settings(max_examples=300, deadline=None)
@given(st.text("ab10_@.-!é\n x²Ⅷ", max_size=14))
def test_hidden_words_against_all_ends(text):
    assert list(toxicity.hidden(text)) == list(plain_hidden(text))


def test_long_unbroken_tokens_take_linear_time():
    m, start = toxicity.Measure(toxicity.Lexicon({"ab": (3, 1.0)})), time.time()
    for text in ("a" + "1" * 10**6, "deadbeef01" * 10**5, "a_" * 500_000, "aA" * 500_000, "a." * 500_000, "a " * 500_000, "!" * 10**6, "x" + "é" * 10**6):
        assert len(m(text)) == len(toxicity.FEATURES) and len(quality_model.statistics(text)) == len(quality_model.STATISTICS)
    assert time.time() - start < 20 and not any(len(w) > m.of.LONGEST for w in [*m.of, *m.of.older])


def brute_scores(x, trees, calibration):
    """Row by row: the sum of each tree's leaf, the logistic function, and the isotonic map by its definition."""
    out = []
    for row in x:
        raw = 1 / (1 + np.exp(-walk(trees, row)))
        if calibration is not None and len(calibration.at):
            at, to = calibration.at, calibration.to
            i = int((at <= raw).sum())
            flat = to[0] if i == 0 else to[-1] if i == len(at) else to[i - 1] + (to[i] - to[i - 1]) * (raw - at[i - 1]) / (at[i] - at[i - 1])
            raw = min(1.0, max(0.0, (1 - calibration.raw) * flat + calibration.raw * raw))
        out.append(raw)
    return np.array(out)


def brute_toxicity_features(text, lexicon):
    """Word by word, over all pairs where something is near something."""
    low = text.lower()
    words = re.findall(r"[^\W\d_]+", low)
    if not words:
        return [0.0] * len(toxicity.FEATURES)

    def best(word):
        terms = [word] + [word[:n] + "*" for n in (4, 5, 6) if len(word) > n]
        return max([lexicon.terms[t] for t in terms if t in lexicon.terms], default=(0, 0.0))

    of, n = [best(w) for w in words], len(words)
    strong, weak = ([i for i, f in enumerate(of) if f[0] == tier] for tier in (3, 2))
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    found = sorted(strong + weak)
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in found)
    disguised = [h.translate(toxicity.STAND_INS) for h in plain_hidden(low)] + [m[0].replace(" ", "") for m in re.finditer(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)", low)]
    faint = [f[1] for f in of if f[0] == 1]
    strong_words = {words[i] for i in strong}
    return [
        len(strong) / n, len(weak) / n, len(strong_words), len({words[i] for i in found}) - len(strong_words),
        max([of[i][1] for i in found], default=0.0), sum(of[i][1] for i in found) / n, np.log1p(len(strong)), np.log1p(len(weak)),
        near / max(1, len(found)), len(faint) / n, sum(faint), len(you) / n, len(disguised) / n, sum(best(h)[0] == 3 for h in disguised if h.isalpha()),
        sum("A" <= c <= "Z" for c in text) / len(text), len(re.findall(r"(?<![^\W\d_])[A-ZÀ-ÖØ-Þ]{3,}(?![^\W\d_])", text)) / n,
        text.count("!") / n, text.count("?") / n, len(re.findall(r"[!?]{2,}", text)) / n, np.log1p(n),
    ]


def test_toxicity_scores_against_brute_force(spark):
    """The query over a whole table, held against features, trees and calibration by their definitions."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows, got = docs.collect(), {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    x = [brute_toxicity_features(r.text or "", model.lexicon) for r in rows]
    assert [got[r.doc_id] for r in rows] == pytest.approx(brute_scores(np.array(x), model.trees, model.calibration))


def test_lexicon_has_all_terms_that_pass(spark):
    """The terms chosen in columns are those that the test in numpy lets through, of the whole sample."""
    docs, labels = frames(spark)
    texts = labelled.sample(docs, labels, "toxic", toxicity.FOLDS, toxicity.HELD).collect()
    counts: dict = {}
    for r in texts:
        for t in {t for w in set(toxicity.WORDS.findall(r.text.lower())) if len(w) > 2 for t in toxicity.terms(w)}:
            counts.setdefault(t, [0, 0])[1 - r.y] += 1
    n_pos = sum(r.y for r in texts)
    names = [t for t, c in counts.items() if c[0] >= 2]
    pos, neg = (np.array([counts[t][i] for t in names], float) for i in (0, 1))
    want = toxicity.lexicon(np.array(names, object), pos, neg, n_pos, len(texts) - n_pos)
    assert toxicity.fit(docs, labels).lexicon.terms == want.terms and len(want.terms) > 20


def test_quality_scores_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality_model.fit(docs, labels)
    rows, got = docs.collect(), {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    x = np.array([quality_model.statistics(r.text or "") for r in rows], float)
    assert [got[r.doc_id] for r in rows] == pytest.approx(brute_scores(x, model, None))


def test_repeated_ids_teach_the_same(spark):
    """Of an id's several texts always the same one is learned from."""
    docs = spark.createDataFrame([(i % 20, f"text {i} of {i % 20}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    a, b = (sorted(map(tuple, labelled.sample(d, labels, "toxic", 5, 0).collect())) for d in (docs.repartition(7), docs.orderBy("text").coalesce(2)))
    assert a == b and len(a) == len({t for t, _, _ in a})


def frames(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.mark.parametrize("model,label,by,held,least", [(toxicity, "toxic", 5, 0, 0.8), (quality_model, "quality", 3, 1, 0.95)])
def test_held_out(spark, model, label, by, held, least):
    docs, labels = frames(spark)
    rows = {r.doc_id: r for r in model.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % by == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    known = [(r[label], rows[r.doc_id].score) for r in labels.collect() if rows[r.doc_id].held_out]
    y, s = np.array([k[0] for k in known], float), np.array([k[1] for k in known])
    assert auc(y, s) > least


@pytest.mark.parametrize("model,label,by,held", [(toxicity, "toxic", 5, 0), (quality_model, "quality", 3, 1)])
def test_held_out_labels_are_not_read(spark, model, label, by, held):
    from pyspark.sql import functions as F

    docs, labels = frames(spark)
    flipped = labels.withColumn(label, F.when(labelled.remainder(F.col("doc_id"), by) == held, 1 - F.col(label)).otherwise(F.col(label)))
    a = {r.doc_id: r.score for r in model.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in model.classify(docs.repartition(3), flipped).collect()}
    assert a == pytest.approx(b)


@pytest.mark.parametrize("model,label", [(toxicity, "toxic"), (quality_model, "quality")])
def test_awkward(spark, awkward, nothing, model, label):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, None), (None, 1), (7, 0), (99, 1)], f"doc_id long, {label} int")
    rows = model.classify(awkward.withColumn("score", awkward.lang), labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert model.classify(nothing, labels).count() == 0
    assert {r.score for r in model.classify(awkward, labels.limit(0)).collect()} == {0.5}


def test_drop_toxic_keeps_columns(spark, awkward):
    docs, labels = frames(spark)
    model = toxicity.fit(docs, labels)
    wide = docs.withColumn("score", docs.lang)
    kept = toxicity.drop_toxic(wide, model)
    assert kept.columns == wide.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.score(docs, model).collect() if not r.predicted}
    assert toxicity.drop_toxic(awkward, model).count() == awkward.count()


def test_labels_of_other_documents_take_no_place(spark):
    docs, labels = frames(spark)
    other = spark.range(1_000_000, 1_020_000).selectExpr("id as doc_id", *(f"0 as {c}" for c in labels.columns if c != "doc_id")).select(labels.columns)
    own = labelled.sample(docs, labels, "toxic", 5, 0, 50)
    mixed = labelled.sample(docs.union(docs.limit(9)), labels.union(other), "toxic", 5, 0, 50)
    assert own.count() == 50 and sorted(map(tuple, mixed.collect())) == sorted(map(tuple, own.collect()))


def test_nothing_fitted_drops_nothing(spark, awkward):
    docs, labels = frames(spark)
    for none in (labels.limit(0), labels.withColumn("doc_id", labels.doc_id + 1_000_000)):
        assert toxicity.drop_toxic(awkward, toxicity.fit(docs, none)).count() == awkward.count()
