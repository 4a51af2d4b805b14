"""What the operators of this package share: the shared folder, bounded broadcasts, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a longest run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only after it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 50_000
#: The same for lists of single ids or fingerprints (8 bytes each).
ID_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and the
    session is a local one (tests), a temporary folder becomes it; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: this cuts the lineage, and a lost
    executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.weftline_path = path
    return made


class Tables:
    """Intermediate tables of one operator, written as materialize() does, that can be deleted when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        made = materialize(df, name)
        self.made.append(made)
        return made

    def delete(self, *, but: DataFrame | None = None, only: DataFrame | None = None) -> None:
        """All tables, or all but one, or only one."""
        gone = [t for t in self.made if t is not but and (only is None or t is only)]
        self.made = [t for t in self.made if not any(t is g for g in gone)]
        for t in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.weftline_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most limit rows, else as it is (Spark then shuffles, and
    splits skewed partitions). df should be cheap to count, such as a materialized table."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its source has fewer (a small file of one row group, say). Large
    inputs have more splits than that, and aren't shuffled. For work that costs much more than a shuffle of its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def public_tokenizer(name: str) -> str:
    """The path of one of the public tokenizers' files, where that package is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered(dict):
    """A dict that makes missing values. Values of keys longer than LONGEST are made anew each time, so
    that the number of entries bounds the memory. When it holds limit of them, they become the older
    generation, and the one before that is forgotten."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    LONGEST = 64

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
