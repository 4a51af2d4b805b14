"""Work that is not done twice: memo tables, ledgers of finished nodes, the state of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def memoized(rows: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], memo: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with value, what is new in the memo). Equal keys are computed once, known ones not at all.

    compute takes rows with distinct keys and returns key and value. memo: key, value.
    """
    one = rows.dropDuplicates([key])
    if memo is not None:
        one = one.join(memo.select(key), key, "left_anti")
    new = compute(one).select(key, "value")
    known = new if memo is None else memo.select(key, "value").unionByName(new)
    return rows.join(known, key, "left"), new


def memo_events(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with kind: memo-miss for the first of each key, memo-hit for the others."""
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    return rows.join(first, key).withColumn("kind", F.when(F.col(order) == F.col("_first"), F.lit("memo-miss")).otherwise(F.lit("memo-hit"))).drop("_first")


def run_key(run_id: Column, signature: Column | None = None) -> Column:
    """The ledger's key: the run, and what it runs over what, so that a reused name meets nothing of another run."""
    return run_id if signature is None else F.when(signature.isNull(), run_id).otherwise(F.concat(run_id, F.lit("\x00"), signature))


def pending(nodes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Nodes (run_key, path) that are not done."""
    return nodes.join(ledger.where("done").select("run_key", "path"), ["run_key", "path"], "left_anti")


def started(ledger: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ledger with nodes begun; what is there already stays."""
    new = nodes.select("run_key", "path").join(ledger.select("run_key", "path"), ["run_key", "path"], "left_anti")
    return ledger.unionByName(new.withColumns({"done": F.lit(False), "value": F.lit(None).cast(ledger.schema["value"].dataType)}))


def finished(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """The ledger with results (run_key, path, value) done."""
    rest = ledger.join(results.select("run_key", "path"), ["run_key", "path"], "left_anti")
    return rest.unionByName(results.select("run_key", "path", F.lit(True).alias("done"), "value"))


def status(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """run_key, status (never-started, in-progress, done), value: by each run's root entry."""
    root = ledger.where("path = ''").select("run_key", "done", "value")
    out = runs.join(root, "run_key", "left")
    return out.select("run_key", F.when(F.col("done"), F.lit("done")).when(F.col("done").isNotNull(), F.lit("in-progress")).otherwise(F.lit("never-started")).alias("status"), F.when(F.col("done"), F.col("value")).alias("value"))
