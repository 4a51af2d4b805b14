"""Files as tables, and tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import archive, blobs

#: Endings of files by type.
ENDINGS = {"text/plain": "txt", "text/markdown": "md", "text/html": "html", "application/json": "json", "application/pdf": "pdf", "application/zip": "zip", "application/gzip": "gz", "application/x-tar": "tar", "image/png": "png", "image/jpeg": "jpg", "text/csv": "csv", "application/xml": "xml"}


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of each file."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: each file whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def archive_files(spark: SparkSession, path: str, kind: str, glob: str | None = None) -> DataFrame:
    """path and a row for each entry of each archive file."""
    return archive.unpack(binary_files(spark, path, glob), kind, "content", ("path",))


def hydrated_refs(spark: SparkSession, refs: DataFrame, base: str) -> DataFrame:
    """refs (file, type) with content and handle, read below base. References that leave base are errors."""
    inside = F.when(F.regexp_like("file", F.lit(r"^/|^\\|(^|/)\.\.(/|$)")) | (F.col("file") == ""), F.raise_error(F.concat(F.lit("unsafe file reference: "), "file"))).otherwise(F.col("file"))
    root = base.rstrip("/")
    stored = binary_files(spark, root).select(F.regexp_replace("path", "^.*" + root.split("://")[-1].replace(".", r"\.") + "/", "").alias("_file"), "content")
    out = refs.withColumn("file", inside).join(stored, F.col("file") == F.col("_file"), "left").drop("_file")
    return out.withColumn("handle", blobs.handle(F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no such file: "), "file")).cast("binary")).otherwise(F.col("content")), F.coalesce("type", F.lit("application/octet-stream"))))


def write_bytes(rows: DataFrame, folder: str, name: str = "name", content: str = "content", mtime: str | None = None) -> DataFrame:
    """Writes each row's bytes below folder, which is a path of the executors' own file system: on a cluster, one that is
    mounted on all of them. (Tables go through Spark's writers, to any file system.) Returns name, path, bytes. Names that leave the folder are errors; a trailing / makes a folder."""
    import os

    import pandas as pd

    def run(frames):
        for frame in frames:
            out = []
            for n, data, when in frame.itertuples(index=False):
                path = archive.safe_path(folder, n)
                if n.endswith("/"):
                    os.makedirs(path, exist_ok=True)
                else:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(path, "wb") as f:
                        f.write(bytes(data))
                    if not pd.isna(when):
                        os.utime(path, (when / 1000, when / 1000))
                out.append((n, path, 0 if data is None else len(data)))
            yield pd.DataFrame(out, columns=["name", "path", "bytes"])

    when = F.lit(None).cast("long") if mtime is None else F.col(mtime)
    return rows.select(F.col(name).alias("name"), F.col(content).alias("content"), when.alias("mtime")).mapInPandas(run, "name string, path string, bytes long")


def handle_names(rows: DataFrame, kind: str = "type", order: str = "pos") -> DataFrame:
    """rows with name: handle-<n>.<ending>, numbered in order. Rows are sorted over all partitions; what is gathered is
    how many each has."""
    endings = F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair))
    spark, schema = rows.sparkSession, T.StructType([*rows.schema, T.StructField("_n", T.LongType())])
    numbered = rows.orderBy(order).rdd.zipWithIndex().map(lambda pair: (*pair[0], pair[1] + 1))
    name = F.concat(F.lit("handle-"), F.col("_n").cast("string"), F.lit("."), F.coalesce(endings[F.col(kind)], F.lit("bin")))
    return spark.createDataFrame(numbered, schema).withColumn("name", name).drop("_n")
