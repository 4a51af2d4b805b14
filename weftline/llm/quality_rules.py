"""Quality rules: fixed limits, then robust multivariate outliers. DataFrame functions only.

For each language and source, the minimum covariance determinant estimate gives the centre and spread
of the statistic vectors of the three quarters of documents that lie closest together: from several
robust starts (medians with median deviations, the same with the correlations of squashed values, and
the half nearest to the medians), the closest documents are taken, their mean and covariance
computed, and so again until the determinant falls no more. Of each group's starts the one that ends with the
least determinant counts. Documents far from the centre by that spread (Mahalanobis distance) are rejected.

Steps run on a table of a few numbers a document and reduce it by group, combined within each
partition first, so a source with a third of all documents costs no more than its rows. What is
joined back are the groups' estimates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, SPACE, Tables, if_small, text_of

#: Limits of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "[#*$%&|<>]"

#: The vector: log of mean word length; log of symbols per 100 words; roots of the repeated words' and repeated lines' share.
#: Each with the least standard deviation it is given, below which differences don't matter. Those of the bounded shares are low
#: enough for each alone to reach the limit (5.8 of them): repeated words from 0.21 of the words on, a repeated line in 24 words.
VECTOR = {"v_length": 0.05, "v_symbols": 0.25, "v_repeats": 0.08, "v_lines": 0.035}
#: Part of a group that its estimate is made of.
CORE = 0.75
#: A step counts if the logarithm of the determinant falls by so much at least; as the floors bound it, the steps end.
FALL = 1e-4
#: A document as far as one in this many of a normal group is still kept.
ODDS = 1e6
#: Documents that a group needs for an estimate of its own. Smaller groups of a language are taken together,
#: and where they are still too few, all of these.
LEAST_GROUP = 50


def chi_square(x: float, df: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def chi_square_at(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, df) < p else (low, mid)
    return low


#: Largest squared distance of a kept document, and what makes the covariance of a normal group's core that of the whole group.
LIMIT = chi_square_at(1 - 1 / ODDS, len(VECTOR))
CONSISTENCY = CORE / chi_square(chi_square_at(CORE, len(VECTOR)), len(VECTOR) + 2)


def window_hash(i: Column) -> Column:
    return F.xxhash64(*(F.get("words", i + step) for step in range(3)))


def repeated_words(rows: DataFrame) -> DataFrame:
    """rows (with words, n_words) and n_repeat_words: words in windows of three that occur twice or more.

    A window's hash and its place share one 64-bit number, so one sort brings equal windows together, and
    neighbours with equal hashes are compared word by word. The longer the text, the fewer bits the hash has: where a
    neighbour has the same hash but other words, the window is compared with all that have this hash.
    """
    n = F.col("n_words")
    rows = rows.withColumn("place", F.expr("shiftleft(1L, cast(ceil(log2(n_words + 1)) as int)) - 1"))
    starts = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)).cast("int"))
    hashed = F.transform(starts, lambda i: window_hash(i).bitwiseAND(F.bitwise_not("place")).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("sorted", F.sort_array(F.when(n >= 3, hashed).otherwise(F.array().cast("array<bigint>"))))

    def hash_equal(k: Column, j: Column) -> Column:
        a, b = F.get("sorted", k), F.get("sorted", j)
        return F.coalesce(a.bitwiseOR(F.col("place")) == b.bitwiseOR(F.col("place")), F.lit(False))

    def same(k: Column, j: Column) -> Column:
        p, q = (F.get("sorted", x).bitwiseAND(F.col("place")).cast("int") for x in (k, j))
        equal = hash_equal(k, j)
        for step in range(3):
            equal = equal & (F.get("words", p + step) == F.get("words", q + step))
        return F.coalesce(equal, F.lit(False))

    every = F.sequence(F.lit(0), F.greatest(F.size("sorted") - 1, F.lit(0)))

    def repeated(k: Column) -> Column:
        neighbour = (k > 0) & hash_equal(k, k - 1) | hash_equal(k, k + 1)
        return neighbour & (same(k, k + 1) | (k > 0) & same(k, k - 1) | F.exists(every, lambda j: (j != k) & same(k, j)))

    rows = rows.withColumn("twice", F.filter(every, repeated))

    def covered(k: Column) -> Column:
        first = F.get("sorted", k).bitwiseAND(F.col("place"))
        return F.sequence(first, first + 2)

    count = F.size(F.array_distinct(F.flatten(F.transform("twice", covered))))
    return rows.withColumn("n_repeat_words", count.cast("long")).drop("place", "sorted", "twice")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    rows = docs.select("doc_id", "lang", "source", text_of().alias("text"))
    rows = rows.select("doc_id", "lang", "source", "text", F.array_remove(F.split("text", SPACE + "+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))
    rows = rows.select(
        "doc_id", "lang", "source", "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return repeated_words(rows).drop("words")


def with_base(stats: DataFrame) -> DataFrame:
    return stats.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def vectors(based: DataFrame) -> DataFrame:
    """The documents that passed the base rules, with their vectors."""
    n = F.col("n_words")
    return based.where("not base_failed").select(
        "row", "lang", "source",
        F.log(F.col("word_chars") / n).alias("v_length"), F.log1p(100 * F.col("n_symbols") / n).alias("v_symbols"),
        F.sqrt(F.col("n_repeat_words") / n).alias("v_repeats"), F.sqrt(F.col("n_dup_lines") / n).alias("v_lines"),
    )


def with_group(rows: DataFrame, tables: Tables) -> DataFrame:
    """rows with part: the language and source if these have enough rows, else the language's small sources together, else the rest."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source"))
    rows = rows.withColumn("part", F.concat_ws("\x1f", lang, source)).withColumn("wider", lang)
    sizes = rows.groupBy("part", "wider").count()
    small = tables.write(sizes.where(F.col("count") < LEAST_GROUP), "small-parts")
    rest = small.groupBy("wider").agg(F.sum("count").alias("together")).withColumnRenamed("wider", "of")
    small = small.join(rest, F.col("wider") == F.col("of")).select(F.col("part").alias("small_part"), F.when(F.col("together") >= LEAST_GROUP, F.concat(F.lit("\x1e"), "wider")).otherwise(F.lit("\x1d")).alias("moved"))
    rows = rows.join(if_small(small), F.col("part") == F.col("small_part"), "left")
    return rows.withColumn("part", F.coalesce("moved", "part")).drop("wider", "small_part", "moved")


def distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor l<i><j>."""
    solved: list[Column] = []
    for i, v in enumerate(names):
        left = F.col(v) - F.col(f"m{i}")
        for j in range(i):
            left = left - F.col(f"l{i}{j}") * solved[j]
        solved.append(left / F.col(f"l{i}{i}"))
    return sum((s * s for s in solved[1:]), solved[0] * solved[0])


def factored(groups: DataFrame, floors: list[float]) -> DataFrame:
    """part, m<i> and c<i><j> to part, m<i> and the Cholesky factor of the covariance with the floors' squares on its diagonal."""
    n, factor = len(floors), {}
    for i, j in cells(n):
        value = F.col(f"c{i}{j}") * CONSISTENCY + (floors[i] ** 2 if i == j else 0)
        for k in range(j):
            value = value - factor[i, k] * factor[j, k]
        factor[i, j] = F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / factor[j, j]
    kept = [c for c in groups.columns if c not in {f"c{i}{j}" for i, j in cells(n)}]
    return groups.select(*kept, *(v.alias(f"l{i}{j}") for (i, j), v in factor.items()))


def log_determinant(n: int) -> Column:
    return sum((2 * F.log(f"l{i}{i}") for i in range(1, n)), 2 * F.log("l00"))


def cells(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1)]


def starts(rows: DataFrame, tables: Tables) -> DataFrame:
    """part, start, m<i>, l<i><j>: three first estimates of each group with enough rows. rows: part and the vector."""
    names, floors = list(VECTOR), list(VECTOR.values())
    n = len(names)
    medians = rows.groupBy("part").agg(F.count("*").alias("n"), *(F.percentile_approx(v, 0.5, 10_000).alias(f"m{i}") for i, v in enumerate(names)))
    medians = tables.write(medians.where(F.col("n") >= LEAST_GROUP).drop("n"), "medians")
    apart = rows.join(if_small(medians), "part").groupBy("part").agg(*(F.percentile_approx(F.abs(F.col(v) - F.col(f"m{i}")), 0.5, 10_000).alias(f"d{i}") for i, v in enumerate(names)))
    middle = medians.join(apart, "part").select("part", *(f"m{i}" for i in range(n)), *(F.greatest(F.col(f"d{i}") * 1.4826, F.lit(floors[i])).alias(f"d{i}") for i in range(n)))
    middle = tables.write(middle, "middle")
    plain = middle.select("part", F.lit("medians").alias("start"), *(f"m{i}" for i in range(n)), *((F.lit(0.0) if i != j else F.col(f"d{i}")).alias(f"l{i}{j}") for i, j in cells(n)))
    z = [(F.col(v) - F.col(f"m{i}")) / F.col(f"d{i}") for i, v in enumerate(names)]
    scaled = rows.join(if_small(middle), "part").select("part", *names, *(F.tanh(c).alias(f"t{i}") for i, c in enumerate(z)), sum((c * c for c in z[1:]), z[0] * z[0]).alias("far"))
    edges = tables.write(scaled.groupBy("part").agg(F.percentile_approx("far", 0.5, 10_000).alias("edge")), "half-edges")
    scaled = scaled.join(if_small(edges), "part")
    near = F.col("far") <= F.col("edge")
    # F.corr divides by zero where a value is the same in all of a group
    spread = [F.stddev_pop(f"t{i}") for i in range(n)]
    sums = [F.try_divide(F.covar_pop(f"t{i}", f"t{j}"), spread[i] * spread[j]).alias(f"r{i}{j}") for i, j in cells(n) if i != j]
    sums += [F.avg(F.when(near, F.col(v))).alias(f"h{i}") for i, v in enumerate(names)]
    sums += [F.covar_pop(F.when(near, F.col(names[i])), F.when(near, F.col(names[j]))).alias(f"k{i}{j}") for i, j in cells(n)]
    made = tables.write(scaled.groupBy("part").agg(*sums).join(if_small(middle), "part"), "start-sums")
    correlation = {(i, j): F.coalesce(F.nanvl(f"r{i}{j}", F.lit(0.0)), F.lit(0.0)) * F.col(f"d{i}") * F.col(f"d{j}") for i, j in cells(n) if i != j}
    squashed = made.select("part", F.lit("squashed").alias("start"), *(f"m{i}" for i in range(n)), *((correlation[i, j] if i != j else F.col(f"d{i}") * F.col(f"d{i}")).alias(f"c{i}{j}") for i, j in cells(n)))
    half = made.select("part", F.lit("nearest half").alias("start"), *(F.col(f"h{i}").alias(f"m{i}") for i in range(n)), *(F.col(f"k{i}{j}").alias(f"c{i}{j}") for i, j in cells(n)))
    return plain.unionByName(factored(squashed, floors)).unionByName(factored(half, floors))


def estimates(rows: DataFrame, tables: Tables | None = None) -> DataFrame:
    """part, centre and Cholesky factor of each group with enough rows, written. rows: part and the vector.

    All groups and starts take their steps together; those whose determinant fell no more have ended.
    """
    tables = tables or Tables(rows.sparkSession)
    names, floors = list(VECTOR), list(VECTOR.values())
    n = len(names)
    model = tables.write(starts(rows, tables).withColumns({"det": F.lit(float("inf")), "ended": F.lit(False)}), "start")
    # a few rows a group: all tables joined here have no more than this one
    marked = F.broadcast if model.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df
    parameters = [c for c in model.columns if c[0] in "ml" and c[1:].isdigit()]
    while True:
        open_ = model.where("not ended").select("part", "start", *parameters)
        far = rows.join(marked(open_), "part").select("part", "start", *names, distance(names).alias("far"))
        edges = far.groupBy("part", "start").agg(F.percentile_approx("far", CORE, 10_000).alias("edge"))
        core = far.join(marked(edges), ["part", "start"]).where(F.col("far") <= F.col("edge"))
        moments = [F.avg(v).alias(f"m{i}") for i, v in enumerate(names)] + [F.covar_pop(names[i], names[j]).alias(f"c{i}{j}") for i, j in cells(n)]
        step = factored(core.groupBy("part", "start").agg(*moments), floors).withColumn("det", log_determinant(n))
        step = step.select("part", "start", F.struct(*parameters, "det").alias("new"))
        # a step that doesn't lower the determinant is not taken, and is the last one
        falls = ~F.col("ended") & F.coalesce(F.col("new.det") <= F.col("det") - FALL, F.lit(False))
        taken = [F.when(falls, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in (*parameters, "det")]
        model = tables.write(model.join(marked(step), ["part", "start"], "left").select("part", "start", *taken, (~falls).alias("ended")), "model")
        if model.where("not ended").isEmpty():
            best = Window.partitionBy("part").orderBy("det", "start")
            return tables.write(model.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place", "start", "det", "ended"), "best")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    outlier_distance (of rejected outliers, else null) for every row of docs. Groups that are too few for an
    estimate reject nothing.

    Null is the empty text. Null languages and sources are values of their own. Repeated rows are judged
    alike, each counts. An empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession)
    based = tables.write(with_base(statistics(docs)).withColumn("row", F.monotonically_increasing_id()), "statistics")
    rows = tables.write(with_group(vectors(based), tables), "vectors")
    model = estimates(rows, tables)
    far = rows.join(if_small(model), "part").select(F.col("row").alias("far_row"), distance(list(VECTOR)).alias("distance"))
    odd = tables.write(far.where(F.col("distance") > LIMIT), "outliers")
    out = based.join(if_small(odd), F.col("row") == F.col("far_row"), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("far_row").isNull()).alias("kept"), F.col("distance").alias("outlier_distance"))
