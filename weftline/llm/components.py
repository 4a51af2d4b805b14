"""Connected components of a graph of links, in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """node, comp: the smallest node that each node of links (a, b) reaches. Materialized.

    Each round takes the least label of a node's neighbours, then the label's own label (so a path's length
    halves at least); labels are written to the shared folder after each round. It ends when no label
    changes. Neighbours are reduced within each partition before they are shuffled, so a hub costs no
    more than its links.
    """
    tables = tables or Tables(links.sparkSession)
    both = links.where("a <> b").select("a", "b").distinct()
    edges = tables.write(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = tables.write(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    written = labels
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("least"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        of = labels.select(F.col("node").alias("label"), F.col("comp").alias("label_comp"))
        step = step.join(of, F.col("comp") == F.col("label"), "left").select("node", "was", F.least("comp", "label_comp").alias("comp"))
        step = tables.write(step, "labels")
        tables.delete(only=written)
        written = step
        if step.where("was <> comp").isEmpty():
            tables.delete(only=edges)
            return step.select("node", "comp")
        labels = step.select("node", "comp")
