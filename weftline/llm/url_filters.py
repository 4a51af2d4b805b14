"""URL filters as a sort-merge range join over reversed-host keys. DataFrame functions only.

A host is turned into a canonical key: its labels in reverse order, each followed by U+0001. All
subdomains of a host then lie in one interval of keys, [key, key with the last U+0001 as U+0002).
The intervals of the rules nest. At each start or end of an interval stands a boundary that carries
the stack of the rules active from there on: a rule's ancestors and itself at its start, its
ancestors at its end. Pages and boundaries are sorted together by key and swept once; each page takes
the stack of the last boundary at or before it, and of this stack the longest rule whose path its own
path starts with.

The sweep is cut into chunks by a hash of the page's whole url and id, so a host with a third of all
pages is spread over all of them; the boundaries (two a rule) are repeated in every chunk. Pages
are shuffled once, and nothing is broadcast or collected.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: host, path, verdict. A rule fits its host and all subdomains of it.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: What a page gets that no rule fits.
DEFAULT_VERDICT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? #
    or the end. Both empty for null and where no :// is."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by U+0001; U+0001 and U+0002 within a label are escaped, so that
    every key that starts with a host's key belongs to it or to a subdomain."""
    clean = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02\x02")), F.lit("\x01"), F.lit("\x02\x03"))
    return F.concat(F.array_join(F.reverse(F.split(clean, r"\.", -1)), "\x01"), F.lit("\x01"))


def boundaries(rules: DataFrame) -> DataFrame:
    """key, closing, stack for each start and end of a rule's interval. Ancestors are found by an
    equi-join of a rule's host suffixes with the rules' hosts, not by comparing all rules."""
    own = rules.withColumn("key", host_key(F.col("host"))).distinct()
    packed = own.groupBy("host", "key").agg(
        F.collect_set(F.struct(F.length(F.concat("host", "path")).alias("len"), F.length("host").alias("host_len"), F.concat("host", "path").alias("rule"), "path", "verdict")).alias("own")
    )
    labels = F.split("host", r"\.", -1)
    suffixes = packed.select("host", "key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    found = suffixes.join(packed.select(F.col("host").alias("suffix"), "own"), "suffix")
    stacks = found.groupBy("host", "key").agg(F.flatten(F.collect_list("own")).alias("full"), F.flatten(F.collect_list(F.when(F.col("suffix") != F.col("host"), F.col("own")))).alias("outer"))
    ends = F.concat(F.substring("key", F.lit(1), F.length("key") - 1), F.lit("\x02"))
    return stacks.select("key", F.lit(0).alias("kind"), F.col("full").alias("stack")).unionByName(stacks.select(ends.alias("key"), F.lit(0).alias("kind"), F.col("outer").alias("stack")))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, url: str = "url", chunks: int | None = None) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict. rules: host, path, verdict.

    Every input column stays, but for those four names, which are replaced. Null urls get empty host
    and path and the default verdict; repeated pages get a row each; empty tables give empty results.
    Of rules that fit, the longest (host and path together) wins, then the one with the longer
    host; block wins over allow where the same host and path has both.
    """
    pages = pages.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else pages
    spark = pages.sparkSession
    n = chunks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_and_path(F.col(url))
    hashed = [F.col(f"`{c.name}`") for c in pages.schema if not re.search("map<|variant", c.dataType.simpleString())]  # those can't be hashed
    chunk = F.pmod(F.xxhash64(*hashed), F.lit(n)).cast("int")
    rows = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"), chunk.alias("chunk"))
    rows = rows.select("row", "host", "path", host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("array<struct<len:int,host_len:int,rule:string,path:string,verdict:string>>").alias("stack"), "chunk")
    marks = boundaries(rules).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).groupBy("chunk", "key", "kind").agg(F.max_by("stack", F.size("stack")).alias("stack"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    sweep = Window.partitionBy("chunk").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where(F.col("kind") == 1)
    fits = F.filter(F.coalesce("active", F.array().cast("array<struct<len:int,host_len:int,rule:string,path:string,verdict:string>>")), lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["len"].alias("len"), r["host_len"].alias("host_len"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))
    return swept.withColumn("best", best).select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
