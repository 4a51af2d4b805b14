"""Mixing sources to target weights: tokens per source, repetition rates, floor copies and a hash-seeded one.

A source's rate is its target over its size. Each of its documents is emitted floor(rate) times, and
once more by a Bernoulli draw that is seeded by a hash of its doc_id and text, so that reruns and retries
agree, and rows that share an id or have none are drawn each for itself. The draw's probability starts as the rate's fraction. As the sum of independent draws strays
from its mean by several hundredths in a small source, the threshold is then moved to the place, among the
source's hashed documents, at which the words taken come nearest to the target: it differs from the
fraction by the draws' sampling error only, and a source misses its target by less than one document (or
by a millionth of its size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, if_small, materialize, text_of

#: Weights by place of the source's name, share of all words to take, most times a source is taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
SEED = "mix"


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """20 bits of a hash of the id and the text."""
    parts = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed), F.md5(text.cast("binary")))
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, 5), 16, 10).cast("long")


def with_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> and target: weights in order of the names (code points, null last), share
    times all words dealt out by weight, none above most times its source: the excess is dealt to the others.

    Sorted by most * size / weight, the sources at their limit come first. level is what a unit of weight
    would get if exactly the sources before stood at their limit: it falls from the first source
    below its limit on, so that source's level is the highest of those below. No loop is needed. The
    table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("left", F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("full", F.col("level") * F.col("weight") > F.col("cap"))
    t = t.withColumn("at", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
    return t.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("at")).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, copies, last: documents whose draw is at most last get one more copy.

    The place of the threshold is searched in two levels of 1,024 buckets, so that what meets in one
    task is at most 1,024 sums a source, whatever the source's size.
    """
    t = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("extra", F.col("target") - F.col("copies") * F.col("source_size"))

    def crossing(rows: DataFrame, bucket: Column, goals: DataFrame) -> DataFrame:
        """For each source its first bucket at which the running sum passes its goal."""
        sums = rows.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("s")).where("s > 0")
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("s").over(run))
        hit = sums.join(if_small(goals).alias("g"), sums["source"].eqNullSafe(F.col("g.source"))).where(F.col("upto") > F.col("g.goal"))
        return hit.groupBy(sums["source"]).agg(F.min(F.struct("b", "s", "upto", "goal")).alias("x")).select("source", "x.*")

    goals = materialize(t.select("source", F.col("extra").alias("goal")), "goals")
    one = materialize(crossing(sized, F.shiftright("draw", 10), goals).select(F.col("source").alias("s1"), F.col("b").alias("b1"), (F.col("goal") - (F.col("upto") - F.col("s"))).alias("goal")), "level1")
    inside = sized.join(if_small(one), sized["source"].eqNullSafe(F.col("s1")) & (F.shiftright("draw", 10) == F.col("b1"))).select("source", "draw", "size")
    two = crossing(inside, F.col("draw"), one.select(F.col("s1").alias("source"), "goal"))
    before = F.col("upto") - F.col("s")
    two = two.select(F.col("source").alias("s2"), F.when(F.col("goal") - before <= F.col("upto") - F.col("goal"), F.col("b") - 1).otherwise(F.col("b")).alias("last"))
    return t.join(two, t["source"].eqNullSafe(two["s2"]), "left").select("source", "source_size", "target", "copies", F.coalesce("last", F.lit(-1)).alias("last"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, draw by document; the thresholds by source), both materialized."""
    sized = docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), draw(F.col("doc_id"), text_of()).alias("draw"))
    sized = materialize(sized, "sizes")
    sources = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    return sized, materialize(thresholds(sized, with_targets(sources, weights, share, most)), "rates")


def taken_copies(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """docs, each with its source's row of rates and n_copies. Needs the column draw."""
    r = if_small(rates.withColumnRenamed("source", "rate_source"))
    return docs.join(r, docs["source"].eqNullSafe(F.col("rate_source"))).withColumn("n_copies", F.col("copies") + (F.col("draw") <= F.col("last")).cast("long"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mixture itself: each document as often as the plan says, with docs' own columns.

    Null texts count no words; null sources are one source, the last. Rows of the same id and
    text are drawn alike (the words of such a group are one step of the threshold). An empty table gives an empty mixture.
    """
    _, rates = plan_mix(docs, weights, share, most)
    own = docs.columns
    rows = docs.select(F.struct("*").alias("row"), "source", draw(F.col("doc_id"), text_of()).alias("draw"))
    out = taken_copies(rows, rates).where("n_copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("n_copies").cast("int")))).select(*[F.col("row").getField(c).alias(c) for c in own])


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    sized, rates = plan_mix(docs, **how)
    return taken_copies(sized, rates).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "source", "n_copies")
