"""Connected components of an undirected graph, by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.shared import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage into the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges between names -> (node, component): the least name of the node's component.

    Every round lowers each label, and the label of what it names, to the least among the neighbours', and then
    to its label's label. Lowering what is named joins whole trees, so that rounds grow with the logarithm of a
    chain's length. Isolated names can be given as self edges.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(pairs.unionAll(pairs.select("y", "x")).toDF("x", "y").distinct())
    labels = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")).withColumnRenamed("x", "node"))
    while True:
        seen = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("l").alias("m"))
        met = labels.join(seen, labels.node == seen.x, "left").select("node", F.least("l", "m").alias("low"), F.col("l").alias("old"))
        hooked = met.unionAll(met.select(F.col("old").alias("node"), "low", F.when(F.lit(False), F.col("old")).alias("old")))
        lower = hooked.groupBy("node").agg(F.min("low").alias("l"), F.max("old").alias("old"))
        jump = lower.select(F.col("node").alias("via"), F.col("l").alias("far"))
        after = cut(lower.join(jump, lower.l == jump.via, "left").select("node", F.least("l", "far").alias("l"), "old"))
        changed = not after.where("l <> old").isEmpty()
        labels = after.select("node", "l")
        if not changed:
            return labels.withColumnRenamed("l", "component")
