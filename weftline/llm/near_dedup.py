"""Near-duplicates by a chosen-path set similarity join.

1. A document becomes its set of word shingles, hashed; equal sets are one class, whose members need
   no comparison. Each class gets a sketch: the least value of its set under each of 128 hash functions.
2. Independent trees branch the classes recursively. A node chooses one or two of the functions (1.25 on
   average, one over the similarity sought, so that a similar pair is expected to stay together in one
   child) by a hash of its path, and a class goes to the child of its minwise token under each. Most
   nodes hold a class alone after one step and are dropped. Nodes of at most WHOLE classes are branched further
   within one task, until few are left, which are compared exhaustively by their sketches; nodes of more are branched as
   tables. A node of which most is similar to its most central class can't be split by branching: that
   class is linked with all that are similar to it, and only the others are compared with all.
3. A node tells of the pairs that look similar no more than a forest. The forests' components are groups; pairs of
   different groups don't look similar in any node.
4. Links are confirmed on full sets. A group of few classes meets in one task, one copy of each set, where all its
   pairs are compared; one of some more meets in parts, every two together. In a group of many each class is first compared with the group's most central one. Then the
   trees are walked again over these groups only: nodes tell which classes of different components look similar, and
   such classes meet, again in parts of bounded size.
5. Links become components by rounds of label propagation in tables.

Trees are repeated until a pair at the threshold meets with the target recall: 12 trees miss a pair of
similarity 0.8 in nodes of the first level with a probability of 0.2 ** 15, in deeper ones of about 0.01 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import ID_ROWS, Tables, if_small

#: Words of a shingle and least similarity (in hundredths) of linked documents.
SHINGLE, ALIKE = 5, 80
#: Hash functions of a sketch, trees, levels at most that are branched as tables and within a task.
SKETCH, TREES, LEVELS, DEEP = 128, 12, 8, 40
#: Classes of a node that are compared exhaustively, and classes of a node that one task gets, at most.
SMALL, WHOLE = 200, 16_384
#: A group's full sets meet in one task if it has at most so many classes and shingles; two classes always may.
GROUP, GROUP_SHINGLES = 400, 1_000_000
#: A larger group meets in parts, every two of them together, if these are at most so many.
PARTS = 12
#: Estimated similarity from which a pair is confirmed: four standard deviations of the estimate below the threshold.
LOOKS = ALIKE / 100 - 4 * (0.8 * 0.2 / SKETCH) ** 0.5
#: Bytes of a batch that a Python task passes on, about.
PASSED = 4 << 20

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
FACTORS = np.random.default_rng(20240101).integers(0, 2**63, (2, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles of k words; with fewer words, of the whole sequence; of no word, none."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if not n:
        return h
    width = min(k, n)
    s = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        s = mixed(s * M1 + h[i : n - width + 1 + i])
    return np.unique(s)


def signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketch(s: np.ndarray) -> np.ndarray:
    """Least value of a set under each hash function."""
    least = np.full(SKETCH, 2**32 - 1, np.uint32)
    for at in range(0, len(s), 1024):
        part = s[at : at + 1024]
        np.minimum(least, ((part[:, None] * FACTORS[0] + FACTORS[1]) >> np.uint64(32)).min(0).astype(np.uint32), out=least)
    return least


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """row, doc_id, n, sig (of the set), sketch for every row of docs."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.IntegerType()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                sizes, sigs, all_sketches = [], [], []
                for t in b.column(1).cast(pa.binary()):
                    s = shingles(t.as_py() or b"", k)
                    sizes.append(len(s))
                    sigs.append(signature(s))
                    all_sketches.append(sketch(s).view(np.int32) if len(s) else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(all_sketches, arrow.types[3])], schema=arrow)

    made = docs.select("doc_id", "text").mapInArrow(make, schema)
    return made.select(F.monotonically_increasing_id().alias("row"), "*")


def chosen(path: Column) -> Column:
    """The functions that a node chooses."""
    first = F.pmod(F.xxhash64(path, F.lit(0)), F.lit(SKETCH))
    second = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(SKETCH))
    two = (F.pmod(F.xxhash64(path, F.lit(2)), F.lit(4)) == 0) & (first != second)
    return F.when(two, F.array(first, second)).otherwise(F.array(first))


def branched(rows: DataFrame, *more: str) -> DataFrame:
    """rows (path, cls, sketch) to the children of their nodes: key for path, without the sketch."""
    rows = rows.select("path", "cls", "sketch", *more, F.explode(chosen(F.col("path"))).alias("i"))
    return rows.select(F.xxhash64("path", "i", F.get("sketch", F.col("i").cast("int"))).alias("key"), "cls", *more)


def agreement(a: Column, b: Column) -> Column:
    """Estimated similarity of two sketches."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(SKETCH))


def most_common(sketches: np.ndarray) -> np.ndarray:
    """For each function the value that most of the sketches have."""
    modes = []
    for column in sketches.T:
        values, counts = np.unique(column, return_counts=True)
        modes.append(values[counts.argmax()])
    return np.array(modes, np.int32)


def centres(rows: DataFrame, tables: Tables) -> DataFrame:
    """key, pivot, pivot_sketch: of each node (rows: key, n, cls, sketch), the class closest to the consensus of about
    SMALL of its classes. These only guide the choice."""

    def consensus(group: pa.Table) -> pa.Table:
        flat = group.column("sketch").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"key": group.column("key")[:1], "middle": pa.array([most_common(flat.reshape(group.num_rows, -1))], pa.list_(pa.int32()))})

    few = rows.where(F.pmod(F.xxhash64("cls", F.lit("few")), F.ceil(F.col("n") / SMALL)) == 0)
    middles = tables.write(few.select("key", "sketch").groupBy("key").applyInArrow(consensus, "key long, middle array<int>"), "middles")
    near = rows.join(if_small(middles, 10_000), "key").select("key", F.struct(agreement(F.col("sketch"), F.col("middle")).alias("near"), (-F.col("cls")).alias("cls"), "sketch").alias("c"))
    best = near.groupBy("key").agg(F.max("c").alias("c"))
    return tables.write(best.select("key", (-F.col("c.cls")).alias("pivot"), F.col("c.sketch").alias("pivot_sketch")), "centres")


def meetings(rows: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """Large nodes (key, n, n_outside, cls, outside) as parts of at most WHOLE classes or so that meet in a task (key, cls);
    and the rows that are branched instead. A node's classes outside its centre, if few, join each part of the
    others. On the last level every two parts of a node meet."""
    size = WHOLE // 2
    few = F.col("n_outside") <= size
    parts = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("cls", F.lit("part")), parts).cast("int")
    every = F.sequence(F.lit(0), parts - 1)
    visit = rows.where(few).select("key", "cls", F.explode(F.when(F.col("outside"), every).otherwise(F.array(own))).alias("part"))
    met = visit.select(F.xxhash64("key", "part").alias("key"), "cls")
    rest = rows.where(~few)
    if last:
        pairs = rest.select("key", "cls", own.alias("own"), F.explode(every).alias("other"))
        met = met.unionByName(pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "cls"))
    return met, rest


def grown(classes: DataFrame, tables: Tables, apart: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes that one task can take on, each set of members once: key, cls, n, sketch, and comp if apart (classes then
    has it, and nodes of one component are left out), sorted by key within partitions. And, if not apart, links (a, b)
    between the centres of larger nodes and what looks similar to them.

    classes: cls, n, sketch. A node's centre is what looks similar to its pivot; if apart, its commonest component.
    """
    more = ["comp"] if apart else []
    trees = F.explode(F.array(*[F.lit(t).cast("long") for t in range(TREES)]))
    rows = branched(classes.select(trees.alias("path"), "cls", "sketch", *more), *more)
    met, stars = None, []
    for level in range(LEVELS):
        mixed_nodes = [F.min("comp").alias("low"), F.max("comp").alias("high")] if apart else []
        nodes = rows.groupBy("key").agg(F.count("*").alias("n"), *mixed_nodes).where("n > 1" + " and low <> high" * apart).select("key", "n")
        nodes = tables.write(nodes, f"nodes{level}")
        members = tables.write(rows.join(if_small(nodes, ID_ROWS), "key"), f"members{level}")
        small = members.where(F.col("n") <= WHOLE).select("key", "cls")
        met = small if met is None else met.unionByName(small)
        if nodes.where(F.col("n") > WHOLE).isEmpty():
            break
        large = members.where(F.col("n") > WHOLE)
        in_large = tables.write(large.select("cls").distinct(), f"in-large{level}")
        large = large.join(classes.select("cls", "sketch").join(if_small(in_large, ID_ROWS), "cls", "left_semi"), "cls")
        if apart:
            counts = large.groupBy("key", "n", "comp").count().groupBy("key", "n").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.max("count").alias("inside"))
            counts = tables.write(counts.select("key", "main", (F.col("n") - F.col("inside")).alias("n_outside")), f"mixed{level}")
            large = large.join(if_small(counts, 10_000), "key").withColumn("outside", F.col("comp") != F.col("main"))
        else:
            large = large.join(if_small(centres(large, tables), 10_000), "key").withColumn("outside", agreement(F.col("sketch"), F.col("pivot_sketch")) < LOOKS)
            large = tables.write(large.drop("pivot_sketch"), f"large{level}")
            stars.append(large.where(~F.col("outside") & (F.col("cls") != F.col("pivot"))).select(F.col("cls").alias("a"), F.col("pivot").alias("b")))
            counts = tables.write(large.groupBy("key").agg(F.sum(F.col("outside").cast("long")).alias("n_outside")), f"outside{level}")
            large = large.join(if_small(counts, 10_000), "key")
        parts, large = meetings(large, level == LEVELS - 1)
        met = met.unionByName(parts)
        rows = branched(large.withColumnRenamed("key", "path"), *more)
    # nodes of the same members in several trees are one
    h = F.xxhash64("cls")
    nodes = met.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h)).alias("y")).where("n > 1")
    once = tables.write(nodes.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "once")
    own = classes.join(if_small(tables.write(met.select("cls").distinct(), "in-nodes"), ID_ROWS), "cls", "left_semi").select("cls", "n", "sketch", *more)
    nodes = met.join(if_small(once, ID_ROWS), "key", "left_semi").join(own, "cls").select("key", "cls", "n", "sketch", *more)
    return nodes.repartition("key").sortWithinPartitions("key", "cls"), stars


def whole_nodes(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Rows sorted by key as arrays (a list column becomes a matrix), cut between nodes only."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = []
        for name in columns:
            c = batch.column(name)
            now.append(c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if pa.types.is_list(c.type) else c.to_numpy())
        held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        last = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last node may go on
        if last:
            yield [x[:last] for x in held]
            held = [x[last:] for x in held]
    if held:
        yield held


def agree_with(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sketches == one).mean(1)


def looking_alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of the pairs of sketches that look similar."""
    out = np.zeros((len(a), len(b)), bool)
    for i, one in enumerate(a):
        out[i] = agree_with(b, one) >= LOOKS
    return out


def children(path: int, sketches: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The children of a node that hold several classes: path, places of the classes."""
    draw = np.random.default_rng(path & (2**63 - 1))
    first, second = (int(x) for x in draw.integers(0, SKETCH, 2))
    for i in {first, second} if draw.random() < 0.25 else {first}:
        order = np.argsort(sketches[:, i], kind="stable")
        tokens = sketches[order, i]
        cuts = np.r_[0, np.flatnonzero(tokens[1:] != tokens[:-1]) + 1, len(tokens)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                yield xxhash.xxh3_64_intdigest(f"{path},{i},{tokens[a]}"), order[a:b]


def forest(alike: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix, from the most connected on."""
    open_, edges = np.ones(len(alike), bool), []
    for i in np.argsort(-alike.sum(1), kind="stable"):
        if not open_[i]:
            continue
        open_[i], todo = False, [i]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(alike[x] & open_)
            open_[new] = False
            edges += [(x, j) for j in new]
            todo += list(new)
    return edges


def linked(path: int, at: np.ndarray, sketches: np.ndarray, depth: int = 0) -> Iterator[tuple[int, int]]:
    """Pairs of places (of at) that look similar in a node or below it: enough to join all that do."""
    sk = sketches[at]
    if len(at) <= SMALL:
        for a, b in forest(looking_alike(sk, sk)):
            yield at[a], at[b]
        return
    sample = sk[:: max(1, len(sk) // SMALL)]
    pivot = int(agree_with(sk, most_common(sample)).argmax())
    near = agree_with(sk, sk[pivot])
    if (near >= ALIKE / 100).mean() >= 0.5 or depth >= DEEP:
        star = near >= LOOKS
        for i in np.flatnonzero(star):
            if i != pivot:
                yield at[pivot], at[i]
        rest = np.flatnonzero(~star)
        for low in range(0, len(rest), SMALL):
            part = rest[low : low + SMALL]
            alike = looking_alike(sk[part], sk)
            # one in the star for each of the rest, and all of the rest among themselves
            some = (alike & star).any(1)
            for i, j in zip(part[some], (alike & star)[some].argmax(1), strict=True):
                yield at[i], at[j]
            for i, row in zip(part, alike[:, rest], strict=True):
                for j in rest[row]:
                    if j > i:
                        yield at[i], at[j]
        return
    for child, own in children(path, sk):
        yield from linked(child, at[own], sketches, depth + 1)


def candidates(rows: DataFrame) -> DataFrame:
    """a, b: enough pairs that look similar to join all classes that do in a node."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cls, sk in whole_nodes(batches, ("key", "cls", "sketch")):
            cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            sizes = np.diff(cuts)
            twos = cuts[:-1][sizes == 2]  # most nodes, all at once
            twos = twos[(sk[twos] == sk[twos + 1]).mean(1) >= LOOKS]
            out = [(cls[twos], cls[twos + 1])]
            for i, n in zip(cuts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                if found := list(linked(int(key[i]), np.arange(i, i + n), sk)):
                    a, b = np.array(found).T
                    out.append((cls[a], cls[b]))
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.mapInArrow(find, "a long, b long")


def in_parts(at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Places in parts of at most half of GROUP classes and half of GROUP_SHINGLES shingles, or one class."""
    parts, start, total = [], 0, 0
    for i, size in enumerate(n[at]):
        if i > start and (total + size > GROUP_SHINGLES // 2 or i - start >= GROUP // 2):
            parts.append(at[start:i])
            start, total = i, 0
        total += size
    return [*parts, at[start:]] if len(at) else parts


def must_meet(path: int, at: np.ndarray, sketches: np.ndarray, n: np.ndarray, comp: np.ndarray, depth: int = 0) -> Iterator[np.ndarray]:
    """Groups of places (of at) whose full sets must meet: each pair that looks similar in a node or below it and is of
    different components is in one."""
    comps, counts = np.unique(comp[at], return_counts=True)
    if len(comps) < 2:
        return
    main = comps[counts.argmax()]
    if len(at) > SMALL and depth < DEEP and counts.max() < len(at) / 2:
        for child, own in children(path, sketches[at]):
            yield from must_meet(child, at[own], sketches, n, comp, depth + 1)
        return
    # what is outside the main component meets all that it looks similar to
    outside = at[comp[at] != main] if len(at) > SMALL else at
    for low in range(0, len(outside), SMALL):
        part = outside[low : low + SMALL]
        alike = looking_alike(sketches[part], sketches[at]) & (comp[part][:, None] != comp[at])
        visitors, hosts = part[alike.any(1)], at[alike.any(0)]
        hosts = np.setdiff1d(hosts, visitors)
        if not len(visitors):
            continue
        ours, theirs = in_parts(visitors, n), in_parts(hosts, n)
        if len(ours) == 1 and len(theirs) <= 1:
            yield np.concatenate([*ours, *theirs])
            continue
        for i, a in enumerate(ours):
            for b in ours[i + 1 :] + theirs:
                yield np.concatenate([a, b])


def meeting_groups(rows: DataFrame) -> DataFrame:
    """key, cls: groups of classes whose full sets must meet, each set of members once in a partition."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for key, cls, n, sk, comp in whole_nodes(batches, ("key", "cls", "n", "sketch", "comp")):
            cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            keys, members = [], []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                for group in must_meet(int(key[i]), np.arange(i, j), sk, n, comp):
                    own = np.sort(cls[group])
                    name = np.int64(xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63)
                    if name not in seen:
                        seen.add(name)
                        keys.append(np.full(len(own), name))
                        members.append(own)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(members))], ["key", "cls"])

    return rows.mapInArrow(find, "key long, cls long")


def with_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """key, cls, s: the full sets of wanted classes (cls, sig, min_id, keys), made again from their texts, for each of
    their keys. A set that stands on several rows may come once for each task."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sigs, sets, size = set(), [], [], 0

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["sig", "s"])
            sigs.clear()
            sets.clear()
            return out

        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                s = shingles(t.as_py() or b"", k)
                sig = signature(s)
                if sig in seen:
                    continue
                seen.add(sig)
                sigs.append(sig)
                sets.append(s.view(np.int64))
                size += s.nbytes
                if size >= PASSED:
                    yield passed()
                    size = 0
        if sigs:
            yield passed()

    ids = if_small(wanted.select(F.col("min_id").alias("wanted_id")).distinct(), ID_ROWS)
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    found = texts.mapInArrow(make, "sig binary, s array<bigint>").join(if_small(wanted.select("sig", "cls", "keys")), "sig")
    return found.select(F.explode("keys").alias("key"), "cls", "s")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets of a group (above the diagonal)."""
    m = len(sets)
    s, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(s, kind="stable")
    s, owner = s[order], owner[order]
    counts, at, d = np.zeros(m * m, np.int64), np.arange(len(s)), 0
    while len(at):  # elements whose next, second next, ... is the same shingle
        d += 1
        at = at[: np.searchsorted(at, len(s) - d)]
        at = at[s[at] == s[at + d]]
        counts += np.bincount(owner[at] * m + owner[at + d], minlength=m * m)
    return counts.reshape(m, m)


def confirmed(rows: DataFrame) -> DataFrame:
    """a, b: for each group (key) of classes a spanning forest of the links between its sets s."""

    def links(cls: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        common, n = overlaps(sets), np.array([len(s) for s in sets])
        similar = np.triu(100 * common >= ALIKE * (n[:, None] + n - common), 1)
        for a, b in forest(similar | similar.T):
            yield min(cls[a], cls[b]), max(cls[a], cls[b])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cls, sets, out = None, [], [], []

        def passed() -> pa.RecordBatch:
            a, b = (pa.array([x[i] for x in out], pa.int64()) for i in (0, 1))
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        for b in batches:
            for k, c, s in zip(b.column("key").to_pylist(), b.column("cls").to_pylist(), b.column("s"), strict=True):
                if k != key:
                    if len(cls) > 1:
                        out += links(cls, sets)
                    key, cls, sets = k, [], []
                if not cls or cls[-1] != c:  # sorted: repeated rows of a class follow each other
                    cls.append(c)
                    sets.append(np.array(s.values.to_numpy(zero_copy_only=False)))
            yield passed()
            out = []
        if len(cls) > 1:
            out += links(cls, sets)
        yield passed()

    return rows.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(find, "a long, b long")


def to_centre(large: DataFrame, candidate_links: DataFrame, docs: DataFrame, tables: Tables, k: int) -> DataFrame:
    """a, b: links between the classes of large groups (cls, sig, min_id, n, comp: the group) and their group's most
    central class, the one with most candidate links."""
    ends = candidate_links.select(F.col("a").alias("cls")).unionAll(candidate_links.select("b")).groupBy("cls").agg(F.count("*").alias("degree"))
    central = large.join(ends, "cls").groupBy("comp").agg(F.max_by("cls", F.struct("degree", -F.col("cls"))).alias("pivot"), F.count("*").alias("of"))
    central = tables.write(large.select(F.col("cls").alias("pivot"), "sig", "min_id", "n").join(central.select("comp", "pivot"), "pivot"), "central")
    sets = tables.write(with_sets(docs, central.select(F.col("pivot").alias("cls"), "sig", "min_id", F.array("comp").alias("keys")), k).dropDuplicates(["key"]), "central-sets")
    narrow = central.agg(F.sum("n")).first()[0] <= 4 * GROUP_SHINGLES  # 32 MB
    sets = sets.select(F.col("key").alias("comp"), F.col("cls").alias("pivot"), F.col("s").alias("pivot_s"))
    own = with_sets(docs, large.select("cls", "sig", "min_id", F.array("comp").alias("keys")), k).withColumnRenamed("key", "comp")
    both = own.join(F.broadcast(sets) if narrow else sets, "comp").where("cls <> pivot")
    sizes = F.size("s") + F.size("pivot_s")
    common = F.size(F.array_intersect("s", "pivot_s"))
    return tables.write(both.where(100 * common >= ALIKE * (sizes - common)).select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct(), "to-centre")


def meeting_keys(comp: Column, cls: Column, parts: Column) -> Column:
    """The keys of a class whose group meets in so many parts, every two of them together."""
    own = F.pmod(F.xxhash64(cls, F.lit("part")), parts).cast("int")
    others = F.filter(F.sequence(F.lit(0), parts.cast("int") - 1), lambda i: i != own)
    return F.when(parts <= 1, F.array(comp)).otherwise(F.transform(others, lambda i: F.xxhash64(comp, F.least(own, i), F.greatest(own, i))))


def class_components(classes: DataFrame, docs: DataFrame, tables: Tables, k: int) -> DataFrame:
    """cls, comp for all classes that are linked with another."""
    nodes, stars = grown(classes, tables, False)
    found = candidates(nodes)
    for star in stars:
        found = found.unionByName(star)
    found = tables.write(found.distinct(), "candidates")
    groups = components(found, tables)
    alike = classes.select("cls", "sig", "min_id", "n").join(if_small(groups.withColumnRenamed("node", "cls"), ID_ROWS), "cls")
    alike = tables.write(alike, "alike")
    sizes = alike.groupBy("comp").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"))
    parts = F.when((F.col("classes") <= 2) | (F.col("classes") <= GROUP) & (F.col("shingles") <= GROUP_SHINGLES), 1).otherwise(
        F.least("classes", F.ceil(2 * F.greatest(F.col("classes") / GROUP, F.col("shingles") / GROUP_SHINGLES)))
    )
    sizes = tables.write(sizes.select("comp", parts.cast("int").alias("parts")).where("parts > 1"), "parted")
    alike = alike.join(if_small(sizes), "comp", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    of_few = alike.where(F.col("parts") <= PARTS).select("cls", "sig", "min_id", meeting_keys(F.col("comp"), F.col("cls"), F.col("parts")).alias("keys"))
    links = tables.write(confirmed(with_sets(docs, of_few, k)), "links")
    if not sizes.where(F.col("parts") > PARTS).isEmpty():
        large = tables.write(alike.where(F.col("parts") > PARTS).drop("parts"), "large-groups")
        first = to_centre(large, found, docs, tables, k)
        so_far = components(first, tables).withColumnRenamed("node", "cls")
        apart = large.drop("comp").join(if_small(so_far, ID_ROWS), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        apart = tables.write(apart.join(classes.select("cls", "sketch"), "cls"), "apart")
        meet = tables.write(meeting_groups(grown(apart, tables, True)[0]).distinct(), "meetings")
        keys = meet.groupBy("cls").agg(F.collect_set("key").alias("keys"))  # a few for each tree
        wanted = tables.write(apart.select("cls", "sig", "min_id").join(keys, "cls"), "to-meet")
        links = links.unionByName(first).unionByName(tables.write(confirmed(with_sets(docs, wanted, k)), "more-links"))
    return components(links, tables).withColumnRenamed("node", "cls")


def mark_near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and sig for every row of docs (columns doc_id and text).

    Documents are linked whose sets of shingles have a similarity of 0.8 or more. component_id is the least
    doc_id that a document reaches by links, itself included (null ids come last); it is kept if that is its
    own. Documents without a word (null is the empty text) are linked with nothing. Rows that repeat a
    doc_id are marked alike. An empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession)
    made = tables.write(sketched(docs, shingle), "sketched")
    full = made.where("n > 0")
    firsts = [F.min("row").alias("cls"), F.min("doc_id").alias("min_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")]
    classes = tables.write(full.groupBy("sig").agg(*firsts), "classes")
    comp = class_components(classes, docs, tables, shingle)
    # a class of one row that is linked with none is its own component, and needs no join
    names = classes.select("cls", "sig", "min_id", "copies").join(if_small(comp, ID_ROWS), "cls", "left").where("copies > 1 or comp is not null")
    names = names.withColumn("comp", F.coalesce("comp", "cls"))
    least = names.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    names = tables.write(names.join(least, "comp").select("sig", "component_id"), "names")
    out = made.select("doc_id", "n", "sig").join(if_small(names), "sig", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    marks = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "sig")
    marks = tables.write(marks, "marks")
    tables.delete(but=marks)
    return marks


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs of which one stays for each component, with docs' own columns. Of rows that repeat a
    doc_id with the same shingles, one stays; rows without a doc_id stay if mark_near_copies keeps them."""
    tables = Tables(docs.sparkSession)
    marks = mark_near_copies(docs, shingle)
    gone = tables.write(marks.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    repeated = tables.write(marks.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("gone_id")), "repeated")
    once = docs.join(if_small(gone.unionByName(repeated), ID_ROWS), docs["doc_id"].eqNullSafe(F.col("gone_id")), "left_anti")
    if repeated.isEmpty():
        return once

    schema = T.StructType([*docs.schema, T.StructField("sig_of_text", T.BinaryType())])
    at = docs.columns.index("text")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = [xxhash.xxh3_128_digest(shingles(t.as_py() or b"", shingle).tobytes()) for t in b.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigs, pa.binary())], [*b.schema.names, "sig_of_text"])

    more = docs.join(repeated, docs["doc_id"].eqNullSafe(F.col("gone_id")), "left_semi").mapInArrow(signed, schema)
    kept = marks.where("kept").select(F.col("doc_id").alias("kept_id"), "sig").distinct()
    more = more.join(kept, more["doc_id"].eqNullSafe(F.col("kept_id")) & (F.col("sig_of_text") == F.col("sig")), "left_semi")
    return once.unionByName(more.dropDuplicates(["doc_id", "sig_of_text"]).drop("sig_of_text"))
