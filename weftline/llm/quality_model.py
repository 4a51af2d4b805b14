"""A quality classifier: histogram gradient-boosted trees over statistics of a document's text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, labelled

#: Rows with this remainder of crc32(doc_id) are held out.
FOLDS, HELD = 3, 1

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_sd", "longest_word", "short_words", "long_words", "distinct_words", "repeated_triples",
    "lines", "words_a_line", "repeated_lines", "shortest_half_lines", "sentence_ends", "capitals", "digits", "commas", "symbols", "bars", "brackets",
    "beyond_ascii", "symbol_ended_words", "entropy", "top_word",
)

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def statistics(text: str) -> list[float]:
    """In the order of STATISTICS; the empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [np.log1p(len(text))] + [0.0] * (len(STATISTICS) - 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_words = np.fromiter((x.count(b" ") + 1 for x in lines), np.int64, len(lines))
    share = counts[counts > 0] / size
    ends = np.fromiter((w[-1] for w in words), np.uint8, n)
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    at = lambda chars: float(counts[np.frombuffer(chars, np.uint8)].sum())
    return [
        np.log1p(len(text)), np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths <= 3).mean(), (lengths > 15).mean(),
        len(distinct) / n, 1 - len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2) if n > 2 else 0.0,
        np.log1p(len(lines)), np.log1p(line_words.mean()), 1 - len(set(lines)) / len(lines), np.log1p(np.median(line_words)),
        at(b".!?") / n, counts[UPPER].sum() / size, counts[DIGIT].sum() / size, at(b",") / n, at(b"#*$%&") / n, at(b"|") / n, at(b"<>{}[]\\") / n,
        counts[128:].sum() / size, np.isin(ends, np.frombuffer(b"#*$%&|<>", np.uint8)).mean(), float(-(share * np.log2(share)).sum()), max(distinct.values()) / n,
    ]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = labelled.FIT_ROWS) -> boosting.Trees:
    """Trees for a 0/1 label, from at most rows labelled documents outside the held-out ones."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(matrix(b.column(0).to_pylist())), pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = labelled.sample(docs, labels, label, FOLDS, HELD, rows).select("text", "y").mapInArrow(measure, "x array<double>, y int").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # whatever the order of the partitions
    return boosting.fit(x[order], y[order])


def score(docs: DataFrame, trees: boosting.Trees, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (columns doc_id and text).

    Null is the empty text, which gets the score of its statistics, all zero. Repeated rows get a row
    each; an empty table gives none. One pass, no shuffle.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = trees.scores(matrix(t.as_py() for t in b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (labelled.remainder(F.col("doc_id"), folds) == held).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
