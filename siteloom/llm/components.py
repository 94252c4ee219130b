"""Connected components by alternating large-star and small-star steps, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) links between integer nodes -> (node, component): the least node of its component.

    Each step takes a grouped minimum (combined before the shuffle) and joins it back, so that a hub's
    rows can be split over tasks by the adaptive skew join; nothing is gathered per node. Edges are
    written to the shared folder after each round. Self links and repeats are ignored; nodes without
    a link to another node don't appear in the result; no links give an empty table.
    """
    now = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc0")
    stamp, step = _stamp(now), 0
    while stamp[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, f"cc{step}l")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("e"))
        after = scratch.write(small.select("e.u", "e.v").where("u <> v").distinct(), f"cc{step + 1}")
        scratch.drop(f"cc{step}", f"cc{step}l")
        now, step, before, stamp = after, step + 1, stamp, _stamp(after)
        if stamp == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
