"""Sinks: where a pipeline's rows can go."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources import blobs

Sink = Callable[[DataFrame, Mapping[str, Any]], None]


def as_json(rows: DataFrame) -> DataFrame:
    """content (UTF-8 JSON of each row) and its handle."""
    json = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.select(json.cast("binary").alias("content")).withColumn("handle", blobs.handle(F.col("content"), "application/json"))


def store(path: str) -> Sink:
    """Appends each row as JSON to a table of blobs; what is stored already is not stored again."""

    def write(rows: DataFrame, options: Mapping[str, Any]) -> None:
        new = as_json(rows).select("content")
        spark = rows.sparkSession
        known = spark.read.schema("sha256 string, content binary").parquet(path) if _exists(spark, path) else spark.createDataFrame([], "sha256 string, content binary")
        blobs.put_new(new, "content", known).write.mode("append").parquet(path)

    return write


def parquet(path: str, mode: str = "append") -> Sink:
    return lambda rows, options: rows.write.mode(options.get("mode", mode)).parquet(path)


def each_batch(sinks: Mapping[str, Sink], written: Callable[[int], bool] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch to all sinks, unless written says that this batch was written before a restart."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if written and written(batch_id):
            return
        batch.persist()
        try:
            for sink in sinks.values():
                sink(batch, {"batch_id": batch_id})
        finally:
            batch.unpersist()

    return run


def registry(own: Mapping[str, Sink] | None = None, store_path: str | None = None) -> dict[str, Sink]:
    """The built-in sink and a host's own; the host's win."""
    return ({"store": store(store_path)} if store_path else {}) | dict(own or {})


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
