"""Many documents into one: the three ways to reconcile, as grouped aggregations.

Each works on rows with a group, a position, a handle's fields and (but for last-write-wins) the text. A group is
one result, so its text has to fit a row; rows are reduced within each partition before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.values import RESERVED

MODES = ("faithful-union", "last-write-wins", "field-merge")
POLICIES = ("last-write-wins", "union", "keep-first")


def faithful_union(rows: DataFrame, group: Sequence[str], pos: str = "pos", sha: str = "sha256", text: str = "text") -> DataFrame:
    """group, text, sha256, size: in order of pos, each distinct document once, under a line that names it.

    A group's text is one value, 2 GB at most: cut groups that grow with the data into blocks, as blocks() does.
    """
    first = rows.groupBy(*group, sha).agg(F.min(F.struct(F.col(pos).alias("pos"), F.col(text).alias("text"))).alias("f"))
    block = F.concat(F.lit("<!-- source: cas/"), F.col(sha), F.lit(" -->\n"), F.col("f.text"))
    blocks = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col("f.pos").alias("pos"), block.alias("block")))).alias("b"))
    out = blocks.select(*group, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("text"))
    return out.withColumns({"sha256": F.sha2("text", 256), "size": F.octet_length("text").cast("long")})


def blocks(pos: Column, size: int) -> Column:
    """Number of the block that a position is in. With it in the group no result grows with the data."""
    return F.floor(pos / size).cast("long")


def last_write_wins(rows: DataFrame, group: Sequence[str], value: Column, produced_at: str = "produced_at", pos: str = "pos") -> DataFrame:
    """group, winner: the value that was produced last, of equals the later one. A row without a time is an error."""
    bad = F.count_if(F.col(produced_at).isNull())
    best = F.max_by(value, F.struct(produced_at, pos))
    return rows.groupBy(*group).agg(bad.alias("_bad"), best.alias("winner")).select(*group, F.when(F.col("_bad") > 0, F.raise_error(F.lit("last-write-wins: a row has no time it was produced at"))).otherwise(F.col("winner")).alias("winner"))


def field_merge(rows: DataFrame, group: Sequence[str], pos: str = "pos", doc: str = "doc", default: str = "last-write-wins", policy: Mapping[str, str] | None = None) -> DataFrame:
    """group, merged: JSON objects merged field by field.

    The last value, the first, or the distinct values of all (arrays concatenated, others as one item) in order
    of appearance. Fields come in the order of their first appearance. Numbers, texts and nested values keep
    their kind.
    """
    for p in (default, *(policy or {}).values()):
        if p not in POLICIES:
            raise ValueError(f"unknown field policy: {p}")
    parsed = rows.select(*group, F.col(pos).alias("_pos"), F.parse_json(F.col(doc)).alias("_v"), F.json_object_keys(F.col(doc)).alias("_keys"), F.from_json(F.col(doc), "map<string,string>").alias("_texts"))
    fields = parsed.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    # a variant sorts the keys of objects, so nested values keep their own text; variants tell texts from the rest
    kind = F.schema_of_variant("value")
    json = F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.col("_texts")[F.col("key")]).otherwise(F.to_json("value"))
    fields = fields.where(F.col("key").isNotNull() & ~F.col("key").isin(*RESERVED)).select(*group, "_pos", F.array_position("_keys", F.col("key")).alias("_key_pos"), "key", F.col("value"), json.alias("_json"))
    is_array = F.schema_of_variant("value").startswith("ARRAY")
    items = F.when(is_array, F.transform(F.from_json("_json", "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array("_json"))
    fields = fields.withColumn("_items", items)
    order = F.struct("_pos", "_key_pos")
    chosen = F.lit(default)
    for key, p in (policy or {}).items():
        chosen = F.when(F.col("key") == key, F.lit(p)).otherwise(chosen)
    # only what is united is gathered; of all other fields one value stays in each partition
    united = F.collect_list(F.when(chosen == "union", F.struct(order.alias("o"), F.col("_items").alias("i"))))
    kept = fields.groupBy(*group, "key").agg(
        F.min(order).alias("_first"), F.max_by("_json", order).alias("_last"), F.min_by("_json", order).alias("_keep"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(united), lambda x: x["i"]))).alias("_union"),
    )
    value = F.when(chosen == "union", F.concat(F.lit("["), F.array_join("_union", ","), F.lit("]"))).when(chosen == "keep-first", F.col("_keep")).otherwise(F.col("_last"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("key").alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    parts = kept.select(*group, "_first", F.concat(quoted, F.lit(":"), value).alias("_part"))
    out = parts.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_first", "_part"))).alias("p"))
    return out.select(*group, F.concat(F.lit("{"), F.array_join(F.transform("p", lambda x: x["_part"]), ","), F.lit("}")).alias("merged"))
