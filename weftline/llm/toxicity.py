"""Toxicity: gradient-boosted trees over dense features, calibrated by an isotonic map.

Features: densities of a lexicon, its nearness to words of the second person, capitals, punctuation,
and obfuscation. The lexicon (words, and prefixes of words for languages that inflect) is learned from
labelled documents by a likelihood-ratio test: all terms that pass it are in. Each labelled document is measured with the lexicon of the
other folds, so that trees and calibration see it as it will be on new documents.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting, labelled
from .shared import Remembered

#: Rows with this remainder of crc32(doc_id) are held out.
FOLDS, HELD = 5, 0
#: Parts of the sample that are measured by the others.
PARTS = 4
#: Least likelihood ratios (twice the log) of the three tiers of the lexicon, and how much more frequent a term must be.
STRONG, WEAK, FAINT, LIFT = 60.0, 18.0, 7.0, 4.0
PREFIXES = (4, 5, 6)
#: Distinct words whose terms a task remembers, and terms it counts before it passes them on.
CACHED_WORDS, COUNTED_TERMS = 100_000, 100_000
#: Words within this distance of one of the lexicon are near it.
NEAR = 5

# Words of the second person in English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer tú ti usted ustedes tus vosotros vuestro".split())
# Characters that stand for letters.
STAND_INS = str.maketrans("013457@$!|", "oieastasil", ".-_*'+")

FEATURES = (
    "strong_density", "weak_density", "strong_distinct", "weak_distinct", "highest_weight", "weight_density", "log_strong", "log_weak", "near_second_person", "faint_density", "faint_weight",
    "second_person", "hidden_density", "hidden_strong", "capitals", "shouted_words", "exclamations", "questions", "marks_in_a_row", "log_words",
)

WORDS = re.compile(r"[^\W\d_]+")
STAND_IN = re.compile(r"[013457@$!|.\-_*'+]")
#: Single letters with blanks between them.
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
SHOUTED = re.compile(r"(?<![^\W\d_])[A-ZÀ-ÖØ-Þ]{3,}(?![^\W\d_])")
IN_A_ROW = re.compile(r"[!?]{2,}")


def is_letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def hidden(low: str) -> Iterator[str]:
    """Letters with stand-ins or marks among them: of each token that begins with a letter and has only letters and digits before
    its first stand-in, what goes to the last letter that ends a word. Each token is passed over twice at most."""
    for token in low.split():
        if not is_letter(token[0]) or (m := STAND_IN.search(token, 1)) is None:
            continue
        at = m.start()
        if at > 1 and not token[1:at].isalnum():
            continue
        after = " "
        for end in range(len(token) - 1, at, -1):
            if is_letter(token[end]) and not (after.isalnum() or after == "_"):
                yield token[: end + 1]
                break
            after = token[end]


def terms(word: str) -> list[str]:
    """A word and its prefixes."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Lexicon:
    """Terms with their weight (log of how much more frequent) and tier: 3 strong, 2 weak, 1 faint."""

    terms: dict[str, tuple[int, float]]

    def of(self, word: str) -> tuple[int, float]:
        """Tier and weight of the best of a word's terms; 0, 0.0 if none is in the lexicon."""
        return max((self.terms[t] for t in terms(word) if t in self.terms), default=(0, 0.0))


def ratio(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> tuple[np.ndarray, np.ndarray]:
    """Twice the log likelihood ratio of a term's documents being spread unevenly, and the log of its lift."""
    n, share = n_pos + n_neg, n_pos / (n_pos + n_neg)
    both = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = sum(np.where(a > 0, a * np.log(np.where(a > 0, a, 1) / np.maximum(e, 1e-12)), 0) for a, e in ((pos, both * share), (neg, both * (1 - share)), (n_pos - pos, (n - both) * share), (n_neg - neg, (n - both) * (1 - share))))
    return 2 * inner, np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))


def told(pos: Column, neg: Column, n_pos: float, n_neg: float) -> Column:
    """Whether a term can be in the lexicon, by ratio() in columns, with room for rounding."""
    n, both = n_pos + n_neg, pos + neg
    share = n_pos / n if n else 0.0
    cells = [(pos, both * share), (neg, both * (1 - share)), (n_pos - pos, (n - both) * share), (n_neg - neg, (n - both) * (1 - share))]
    inner = sum((F.when((a > 0) & (e > 0), a * F.log(a / e)).otherwise(0.0) for a, e in cells), F.lit(0.0))
    lift = F.log((pos + 0.5) / (n_pos + 1)) - F.log((neg + 0.5) / (n_neg + 1))
    return (2 * inner >= FAINT - 0.01) & (lift >= np.log(LIFT) - 0.01)


def lexicon(names: np.ndarray, pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> Lexicon:
    if not (n_pos and n_neg and len(names)):
        return Lexicon({})
    test, lift = ratio(pos.astype(float), neg.astype(float), n_pos, n_neg)
    tiers = sum((test >= least).astype(int) for least in (STRONG, WEAK, FAINT)) * (lift >= np.log(LIFT))
    return Lexicon({str(t): (int(k), float(w)) for t, k, w in zip(names, tiers, lift, strict=True) if k})


class Measure:
    """Features of texts by one lexicon."""

    def __init__(self, words: Lexicon):
        self.of = Remembered(words.of, CACHED_WORDS)

    def __call__(self, text: str) -> list[float]:
        low = text.lower()
        words = WORDS.findall(low)
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        every = [(i, f) for i, f in enumerate(map(self.of.__getitem__, words)) if f[0]]
        found = [(i, f) for i, f in every if f[0] > 1]
        faint = [f[1] for _, f in every if f[0] == 1]
        strong = [i for i, f in found if f[0] == 3]
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON] if found else []
        near = 0
        if you and found:
            at = np.searchsorted(you, [i for i, _ in found])
            marks = np.array([-(10**9), *you, 10**9])
            here = np.array([i for i, _ in found])
            near = int((np.minimum(here - marks[at], marks[at + 1] - here) <= NEAR).sum())
        seconds = len(you) if found else sum(w in SECOND_PERSON for w in words)
        disguised = [h.translate(STAND_INS) for h in hidden(low)] + [m[0].replace(" ", "") for m in SPACED.finditer(low)]
        meant = [self.of[h] for h in disguised if h.isalpha()]
        upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        return [
            len(strong) / n, (len(found) - len(strong)) / n, len({words[i] for i in strong}), len({words[i] for i, _ in found}) - len({words[i] for i in strong}),
            max((f[1] for _, f in found), default=0.0), sum(f[1] for _, f in found) / n, np.log1p(len(strong)), np.log1p(len(found) - len(strong)),
            near / max(1, len(found)), len(faint) / n, sum(faint), seconds / n, len(disguised) / n, sum(k == 3 for k, _ in meant), upper / len(text), len(SHOUTED.findall(text)) / n,
            text.count("!") / n, text.count("?") / n, len(IN_A_ROW.findall(text)) / n, np.log1p(n),
        ]

    def matrix(self, texts) -> np.ndarray:
        return np.array([self(t) for t in texts], float).reshape(-1, len(FEATURES))


def count_terms(texts: DataFrame) -> DataFrame:
    """term, part, pos, neg: documents of the sample with each term, by part of the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, int], int] = {}

        def counted() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen], pa.int32()), pa.array([v * k[2] for k, v in seen.items()], pa.int64()), pa.array([v * (1 - k[2]) for k, v in seen.items()], pa.int64())], ["term", "part", "pos", "neg"])
            seen.clear()
            return made

        for b in batches:
            for t, y, part in zip(*b.columns, strict=True):
                y, part = y.as_py(), part.as_py()
                for term in {x for w in set(WORDS.findall(t.as_py().lower())) if len(w) > 2 for x in terms(w)}:
                    seen[term, part, y] = seen.get((term, part, y), 0) + 1
                if len(seen) >= COUNTED_TERMS:
                    yield counted()
        if seen:
            yield counted()

    return texts.select("text", "y", "fold").mapInArrow(count, "term string, part int, pos long, neg long").groupBy("term", "part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


@dataclass
class Model:
    lexicon: Lexicon
    trees: boosting.Trees
    calibration: boosting.Isotonic
    fitted: bool = True

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.calibration(self.trees.scores(x))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = labelled.FIT_ROWS) -> Model:
    """From at most rows labelled documents outside the held-out ones. No labels give a score of 0.5."""
    texts = labelled.sample(docs, labels, label, FOLDS, HELD, rows)
    sizes = {r["fold"]: (r["pos"], r["n"] - r["pos"]) for r in texts.groupBy("fold").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).collect()}
    n_pos, n_neg = sum(p for p, _ in sizes.values()), sum(n for _, n in sizes.values())
    counted = count_terms(texts).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *(F.sum(F.when(F.col("part") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(PARTS) for c in ("pos", "neg")))
    parts = [(F.col("pos"), F.col("neg"), n_pos, n_neg)]
    for k in range(PARTS):
        own = sizes.get(k, (0, 0))
        parts.append((F.col("pos") - F.col(f"pos{k}"), F.col("neg") - F.col(f"neg{k}"), n_pos - own[0], n_neg - own[1]))
    got = counted.where((F.col("pos") >= 2) & functools.reduce(operator.or_, (told(*part) for part in parts))).orderBy("term").toArrow()
    names = np.array(got.column("term").to_pylist(), object)
    col = lambda c: got.column(c).to_numpy().astype(float)
    whole = lexicon(names, col("pos"), col("neg"), n_pos, n_neg)
    others = [lexicon(names, col("pos") - col(f"pos{k}"), col("neg") - col(f"neg{k}"), n_pos - sizes.get(k, (0, 0))[0], n_neg - sizes.get(k, (0, 0))[1]) for k in range(PARTS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [Measure(o) for o in others]
        for b in batches:
            xs = [by[k.as_py()](t.as_py()) for t, k in zip(b.column(0), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "y", "fold"])

    seen = texts.select("text", "y", "fold").mapInArrow(measure, "x array<double>, y int, fold int").toArrow()
    x = np.array(seen.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y, fold = seen.column("y").to_numpy().astype(float), seen.column("fold").to_numpy()
    order = np.lexsort((*x.T, fold, y))  # whatever the order of the partitions
    x, y, fold = x[order], y[order], fold[order]
    raw = np.zeros(len(y))
    for k in range(PARTS):
        if (fold == k).any():
            raw[fold == k] = boosting.fit(x[fold != k], y[fold != k]).scores(x[fold == k])
    return Model(whole, boosting.fit(x, y), boosting.isotonic(raw, y), len(y) > 0)


def score(docs: DataFrame, model: Model, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (columns doc_id and text).

    Null is the empty text; texts without a word get the score of features that are all zero. Repeated rows
    get a row each; an empty table gives none. One pass, no shuffle.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model.lexicon)
        for b in batches:
            s = model.scores(measure.matrix(t.as_py() for t in b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (labelled.remainder(F.col("doc_id"), folds) == held).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with docs' own columns. Scores travel with the rows, so
    nothing is joined. A model that nothing was fitted on rejects nothing."""
    if not model.fitted:
        return docs
    schema = docs.schema
    at = schema.names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model.lexicon)
        for b in batches:
            yield b.filter(pa.array(model.scores(measure.matrix(t.as_py() or "" for t in b.column(at))) < 0.5))

    return docs.mapInArrow(keep, schema)
