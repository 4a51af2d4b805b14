"""Exact dedup by counting quotient filters, with byte verification of what they count twice.

1. Each partition turns the fingerprints (64 bits) of its normalised texts into counting quotient
   filters: the high bits are quotients, the low bits remainders, kept sorted within their quotient's
   run, with a count each.
2. Filters are cut by quotient into slices; the slices of all partitions meet by number and are
   merged by their sorted remainders, counts added. This loses nothing: a filter of the whole corpus
   is what comes out, in slices of bounded size. Copies of one text are one entry a partition, so a
   group that holds a third of all rows weighs no more than any other.
3. Rows whose fingerprint counts one are done. The others' normalised texts are grouped by their
   bytes (combined within each partition first), so two texts of one fingerprint never become one.

Texts cross no Python boundary, only fingerprints do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, if_small, materialize, text_of

#: Bits of the quotient. A remainder has the other bits of the 64.
QUOTIENT_BITS = 32
#: Fingerprints that a partition gathers before it closes a filter and starts the next.
FILTER_ENTRIES = 1 << 20
#: Fingerprints a slice should hold at most, on average.
SLICE_ENTRIES = 1 << 20


class CountingQuotientFilter:
    """A closed (read-only) filter: for each occupied quotient, in order, the length of its run; the
    runs' remainders, sorted; and the counts."""

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """From fingerprints (uint64) in any order, repeated or with counts."""
        keys, where = np.unique(fingerprints.astype(np.uint64), return_inverse=True)
        n = np.bincount(where, weights=None, minlength=len(keys)) if counts is None else np.zeros(len(keys), np.int64)
        if counts is not None:
            np.add.at(n, where, counts)
        quotients, runs = np.unique((keys >> np.uint64(64 - QUOTIENT_BITS)).astype(np.uint32), return_counts=True)
        return cls(quotients, runs.astype(np.uint32), (keys & np.uint64((1 << (64 - QUOTIENT_BITS)) - 1)).astype(np.uint32), n.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients.astype(np.uint64), self.runs) << np.uint64(64 - QUOTIENT_BITS)) | self.remainders.astype(np.uint64)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both as one: entries are merged in order of quotient and remainder, counts of equal ones added."""
        a, b = self.fingerprints(), other.fingerprints()
        keys, counts = np.empty(len(a) + len(b), np.uint64), np.empty(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + np.searchsorted(b, a, "left")
        at_b = np.arange(len(b)) + np.searchsorted(a, b, "right")
        keys[at_a], keys[at_b], counts[at_a], counts[at_b] = a, b, self.counts, other.counts
        if not len(keys):
            return self
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        merged = CountingQuotientFilter.of(keys[first])
        merged.counts = np.add.reduceat(counts, first)
        return merged

    def slices(self, bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """Cut by the quotients' top bits; only slices with entries."""
        if not len(self.quotients):
            return
        tops = self.quotients >> np.uint32(QUOTIENT_BITS - bits) if bits else np.zeros(len(self.quotients), np.uint32)
        cuts = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]])
        ends, rows = np.r_[cuts[1:], len(tops)], np.r_[0, np.cumsum(self.runs)]
        for i, j in zip(cuts, ends, strict=True):
            yield int(tops[i]), CountingQuotientFilter(self.quotients[i:j], self.runs[i:j], self.remainders[rows[i] : rows[j]], self.counts[rows[i] : rows[j]])

    def to_bytes(self) -> bytes:
        """Counts of one take a bit, others eight bytes."""
        many = self.counts > 1
        head = np.array([len(self.quotients), len(self.remainders)], np.uint64)
        return b"".join(x.tobytes() for x in (head, self.quotients, self.runs, self.remainders, np.packbits(many), self.counts[many]))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        q, n = (int(x) for x in np.frombuffer(raw, np.uint64, 2))
        at = 16
        quotients, at = np.frombuffer(raw, np.uint32, q, at), at + 4 * q
        runs, at = np.frombuffer(raw, np.uint32, q, at), at + 4 * q
        remainders, at = np.frombuffer(raw, np.uint32, n, at), at + 4 * n
        many, at = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at), count=n).astype(bool), at + (n + 7) // 8
        counts = np.ones(n, np.int64)
        counts[many] = np.frombuffer(raw[at:], np.int64)
        return cls(quotients, runs, remainders, counts)


def build_filters(fingerprints: DataFrame, bits: int) -> DataFrame:
    """slice, filter: the slices of each partition's filters."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(parts: list[np.ndarray]) -> pa.RecordBatch:
            cut = list(CountingQuotientFilter.of(np.concatenate(parts)).slices(bits))
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in cut], pa.int32()), pa.array([f.to_bytes() for _, f in cut], pa.binary())], ["slice", "filter"])

        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= FILTER_ENTRIES:
                yield closed(held)
                held, n = [], 0
        if n:
            yield closed(held)

    return fingerprints.mapInArrow(build, "slice int, filter binary")


def merge_filters(filters: DataFrame) -> DataFrame:
    """fp, n: what the merged filter counts more than once."""

    def merge(group: pa.Table) -> pa.Table:
        done: list[CountingQuotientFilter] = []  # sizes fall, as in a binary counter: each entry is merged a few times only
        for raw in group.column("filter"):
            f = CountingQuotientFilter.from_bytes(raw.as_py())
            while done and len(done[-1].counts) <= 2 * len(f.counts):
                f = done.pop().merge(f)
            done.append(f)
        while len(done) > 1:
            f = done.pop()
            done.append(done.pop().merge(f))
        again = done[0].counts > 1
        return pa.table({"fp": done[0].fingerprints()[again].view(np.int64), "n": done[0].counts[again]})

    return filters.groupBy("slice").applyInArrow(merge, "fp long, n long")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """row, doc_id, fp, chars, sha for every row of docs, materialized. row tells repeated rows apart."""
    norm = docs.select("doc_id", F.length(text_of()).alias("chars"), normalised(text_of()).alias("norm"))
    return materialize(norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("norm").alias("fp"), "chars", F.sha2("norm", 256).alias("sha")), "fingerprints")


def groups(docs: DataFrame, base: DataFrame) -> DataFrame:
    """sha, keep_id, group_size of every text that occurs more than once, verified by its bytes."""
    bits = max(4, math.ceil(math.log2(max(1, base.count()) / SLICE_ENTRIES + 1e-9)))
    again = materialize(merge_filters(build_filters(base.select("fp"), bits)), "repeated").select("fp")
    routed = base.join(if_small(again), "fp", "left_semi").select(F.col("doc_id").alias("routed_id")).distinct()
    texts = docs.select("doc_id", "text").join(routed, F.col("doc_id").eqNullSafe(F.col("routed_id")), "left_semi")
    texts = texts.select("doc_id", F.length(text_of()).alias("chars"), normalised(text_of()).alias("norm"))
    same = texts.groupBy("norm", "chars").agg(F.count("*").alias("n"), F.min("doc_id").alias("id"))
    same = same.select(F.sha2("norm", 256).alias("sha"), "chars", "n", "id")
    found = same.groupBy("sha").agg(F.sum("n").alias("group_size"), F.max_by("id", "chars").alias("keep_id"))
    return materialize(found.where("group_size > 1"), "groups")


def mark_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (columns doc_id and text).

    Texts are equal when they are after every ASCII white-space character is deleted; null is the empty
    text. Of equal texts the row with most code points stays, of these the one with the smallest
    doc_id (null ids come last). Of rows that repeat a doc_id with an equal text, one is kept.
    An empty table gives an empty result.
    """
    base = fingerprints(docs)
    found = groups(docs, base)
    g = if_small(found)
    keeps = base.join(g, "sha").where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.min("row").alias("keep_row"))
    g = if_small(materialize(found.join(keeps, "sha"), "keeps"))
    out = base.join(g, "sha", "left")
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that mark_copies keeps, with docs' own columns."""
    marks = materialize(mark_copies(docs).select("doc_id", "kept", "text_sha256"), "marks")
    repeated = materialize(marks.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again_id")), "again")
    # ids are few or many; rows without a repeated id need no text hash
    gone = marks.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    if repeated.isEmpty():
        return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone_id")), "left_anti")
    once = docs.join(gone.unionByName(repeated.select(F.col("again_id").alias("gone_id"))), docs["doc_id"].eqNullSafe(F.col("gone_id")), "left_anti")
    more = docs.join(repeated, docs["doc_id"].eqNullSafe(F.col("again_id")), "left_semi").withColumn("sha_of_text", F.sha2(normalised(text_of()), 256))
    kept = marks.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    more = more.join(kept, more["doc_id"].eqNullSafe(F.col("kept_id")) & (F.col("sha_of_text") == F.col("kept_sha")), "left_semi")
    # of rows that repeat id and normalised text, the longest text stays
    best = more.groupBy("doc_id", "sha_of_text").agg(F.max_by(F.struct(*docs.columns), F.length(text_of())).alias("row"))
    return once.unionByName(best.select("row.*"))
