"""Connected components of a graph in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; label is the smallest node that can be reached.

    Each round gives a node the smallest label among its neighbours and itself and then that label's own label, so a
    path of n nodes takes about log n rounds.  Labels and edges stay distributed; only the number of changes comes to
    the driver.  Rounds are written to the checkpoint folder.
    """
    both = held(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = held(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = held(lower.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")))
        labels = stepped.select("node", "label")
        if stepped.where("label <> old").isEmpty():
            return labels
