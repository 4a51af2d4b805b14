import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import quality_rules as x
from weftline.llm.shared import Tables


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def columns(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_statistics_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = x.judge(docs).collect()
    assert {r.doc_id: columns(r) for r in rows} == {d: brute(t) for d, t in texts.items()}
    assert not any(r.kept and r.base_failed for r in rows)
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k for q, k in judged if q]) > 0.99 and np.mean([k for q, k in judged if not q]) < 0.2


def test_awkward(spark, awkward, nothing):
    extra = spark.createDataFrame([(100 + i, t, "en", "a", 0) for i, t in enumerate(["a b c a b c", "a a a a", "a a a", "x\ny\nx\n \n \n", " a", "é é é é|"])], awkward.schema)
    docs = awkward.unionByName(extra).withColumn("words", F.lit("clash"))
    rows = x.judge(docs).collect()
    texts = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert sorted((str(r.doc_id), *columns(r)) for r in rows) == sorted((d, *brute(t)) for d, t in texts)
    assert x.judge(nothing).count() == 0


def steps(v, centre, cov):
    """Concentration steps until the determinant falls no more, in numpy."""
    floors, was = np.array(list(x.VECTOR.values())), np.inf
    while True:
        far = np.einsum("ij,jk,ik->i", v - centre, np.linalg.inv(cov), v - centre)
        core = v[far <= np.sort(far)[int(np.ceil(x.CORE * len(v))) - 1]]
        new = core.mean(0), np.cov(core.T, bias=True) * x.CONSISTENCY + np.diag(floors**2)
        det = np.linalg.slogdet(new[1])[1]
        if det > was - x.FALL:
            return was, centre, cov
        was, (centre, cov) = det, new


def mcd(v):
    """The least determinant of many starts: the three of the operator's, and random ones."""
    floors, rnd = np.array(list(x.VECTOR.values())), np.random.default_rng(1)
    middle = np.median(v, 0)
    scale = np.maximum(np.median(np.abs(v - middle), 0) * 1.4826, floors)
    z = (v - middle) / scale
    near = v[np.argsort((z * z).sum(1))[: len(v) // 2]]
    found = [steps(v, middle, np.diag(scale**2)), steps(v, near.mean(0), np.cov(near.T) * x.CONSISTENCY + np.diag(floors**2))]
    for _ in range(30):
        few = v[rnd.choice(len(v), 6, replace=False)]
        found.append(steps(v, few.mean(0), np.cov(few.T) + np.diag(floors**2)))
    _, centre, cov = min(found, key=lambda f: f[0])
    return np.einsum("ij,jk,ik->i", v - centre, np.linalg.inv(cov), v - centre)


def group(rnd, n, away):
    """Correlated vectors, some of them in a tight cluster away from the others."""
    v = rnd.normal(size=(n, 4)) @ rnd.normal(size=(4, 4)) + 3
    v[:away] = rnd.normal(size=(away, 4)) * 0.1 + 25
    return v


@pytest.mark.parametrize("seed", [2, 3, 4])
def test_distances_are_those_of_the_least_determinant(spark, seed):
    """Held against many starts in numpy, one of which may end a little lower: verdicts are the same."""
    v = group(np.random.default_rng(seed), 301, 40)
    rows = spark.createDataFrame([(i, "p", *map(float, r)) for i, r in enumerate(v)], "row long, part string, " + ", ".join(f"{n} double" for n in x.VECTOR))
    got = rows.join(x.estimates(rows), "part").select("row", x.distance(list(x.VECTOR)).alias("d")).collect()
    want = mcd(v)
    assert [r.d for r in sorted(got)] == pytest.approx(list(want), rel=0.25)
    assert [r.d > x.LIMIT for r in sorted(got)] == list(want > x.LIMIT)
    assert (want[:40] > x.LIMIT).all() and (want[40:] < x.LIMIT).all()


def test_values_that_are_all_the_same(spark):
    """In every column, in one, and in none but for one row."""
    columns = "row long, part string, " + ", ".join(f"{n} double" for n in x.VECTOR)
    same = [(i, "a", 1.0, 0.0, 0.0, 0.0) for i in range(60)] + [(100 + i, "b", 1.0 + i % 7 / 100, 0.0, 0.3, 0.0) for i in range(60)]
    rows = spark.createDataFrame([*same, (60, "a", 9.0, 0.0, 0.0, 0.0)], columns)
    far = {r.row: r.d for r in rows.join(x.estimates(rows), "part").select("row", x.distance(list(x.VECTOR)).alias("d")).collect()}
    assert len(far) == 121 and [i for i, d in far.items() if d > x.LIMIT] == [60]


def test_kept_against_brute_force(spark):
    """The verdicts over a whole table, from texts to kept."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.lang, r.source, brute(r.text)) for r in docs.collect()]
    passed = [r for r in rows if not r[3][5]]
    sizes: dict = {}
    for _, lang, source, _ in passed:
        sizes[lang, source] = sizes.get((lang, source), 0) + 1
    together: dict = {}
    for (lang, _), n in sizes.items():
        together[lang] = together.get(lang, 0) + (n if n < x.LEAST_GROUP else 0)
    groups: dict = {}
    for d, lang, source, (n, chars, symbols, dup, repeats, _) in passed:
        own = (lang, source) if sizes[lang, source] >= x.LEAST_GROUP else (lang,) if together[lang] >= x.LEAST_GROUP else ()
        v = (np.log(chars / n), np.log1p(100 * symbols / n), np.sqrt(repeats / n), np.sqrt(dup / n))
        groups.setdefault(own, []).append((d, v))
    far = {}
    for own in groups.values():
        if len(own) >= x.LEAST_GROUP:
            far |= dict(zip([d for d, _ in own], mcd(np.array([v for _, v in own])), strict=True))
    got = {r.doc_id: r.kept for r in x.judge(docs).collect()}
    clear = {d for d, _, _, b in rows if b[5] or abs(far.get(d, 0) - x.LIMIT) > 0.05 * x.LIMIT}  # quantiles may differ by a row
    assert len(clear) > 0.99 * len(rows)
    assert {d: got[d] for d in clear} == {d: not b[5] and far.get(d, 0) <= x.LIMIT for d, _, _, b in rows if d in clear}


def test_windows_of_equal_hash(spark, monkeypatch):
    """Many windows of other words with the same hash stand between repeated ones."""
    monkeypatch.setattr(x, "window_hash", lambda i: (F.length(F.get("words", i)) % 2).cast("long"))
    rnd = np.random.default_rng(3)
    texts = [" ".join(rnd.choice(["a", "bb", "c", "dd", "e", "ff"], 60)) for _ in range(20)] + ["a b", "", "a a a a"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: columns(r) for r in x.with_base(x.statistics(docs)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_small_groups_are_taken_together(spark):
    rows = spark.createDataFrame([(i, "en", f"s{i % 9}") for i in range(200)] + [(i, "fr", None) for i in range(200, 260)] + [(i, None, "q") for i in range(260, 290)] + [(i, "de", "q") for i in range(290, 300)], "row long, lang string, source string")
    parts = {}
    for r in x.with_group(rows, Tables(spark)).collect():
        parts.setdefault(r.part, set()).add(r.lang)
    assert sorted(map(repr, parts.values())) == sorted(map(repr, [{"en"}, {"fr"}, {None, "de"}]))


def test_constants():
    assert x.LIMIT == pytest.approx(33.377, abs=0.01) and x.CONSISTENCY == pytest.approx(1.486, abs=0.01)


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert not re.search("Python|Pandas|Arrow", x.statistics(docs)._jdf.queryExecution().executedPlan().toString())
