"""A bounded sample of labelled documents, and the folds of held-out ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, text_of

#: Labelled rows a classifier is fitted on at most. Those with the smallest hash of their id are taken.
FIT_ROWS = 20_000


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, mod by. The null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int = FIT_ROWS) -> DataFrame:
    """text, y, fold (0 to 3) of at most rows labelled documents that are not held out, materialized.

    Null labels and ids are left out; an id with several labels has the one that most of them say, 1 in a tie;
    of an id's several texts the one with the least hash is taken.
    """
    own = labels.select(F.col("doc_id").alias("label_id"), F.col(label).alias("y")).where("label_id is not null and y is not null")
    own = own.where(remainder(F.col("label_id"), folds) != held).groupBy("label_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    ids = docs.select(F.col("doc_id").alias("own_id")).distinct()  # labels of ids that docs doesn't have take no place
    own = own.join(ids, F.col("label_id") == F.col("own_id"), "leftsemi")
    few = materialize(own.orderBy(F.xxhash64("label_id", F.lit(label)), "label_id").limit(rows), f"{label}-rows")
    joined = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("label_id"))
    # an id may be repeated in docs: then the text with the least hash is taken, so that reruns learn the same
    joined = joined.groupBy("label_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    joined = joined.select("text", "y", F.pmod(F.xxhash64("label_id", F.lit("fold")), F.lit(4)).cast("int").alias("fold"))
    return materialize(joined, f"{label}-texts")
