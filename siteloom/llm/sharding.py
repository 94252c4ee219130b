"""Minimax contiguous sharding: groups in order, cut where the largest shard is as small as can be.

Documents of equal text are one atomic group; groups are ordered by their least doc_id. With running
sums of the group sizes, a shard capacity is feasible if at most k greedy fills reach the end. Greedy
needs only "the last running sum within reach of the present cut", so one aggregate over the table of
groups answers it for many capacities at once; a k-ary search over capacities narrows to the smallest.
All of it is DataFrame code: the driver sees capacities and cuts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch, bounds, bucket, parallelism

#: Capacities tried in one pass over the groups.
PROBES = 24


def _fill(groups: DataFrame, capacities: list[int], shards: int, total: int) -> list[list[int]]:
    """The greedy cuts (running sums at which each shard ends) under each capacity."""
    cuts = [[0] for _ in capacities]
    for _ in range(shards):
        reach = [c[-1] + cap for c, cap in zip(cuts, capacities)]
        if all(c[-1] >= total for c in cuts):
            break
        row = groups.agg(*(F.max(F.when(F.col("upto") <= F.lit(r).cast("long"), F.col("upto"))).alias(f"c{i}") for i, r in enumerate(reach))).first()
        for i, c in enumerate(cuts):
            c.append(max(c[-1], row[i] or 0))
    return cuts


def smallest_cuts(groups: DataFrame, shards: int, total: int, largest: int) -> tuple[int, list[int]]:
    """groups(upto): running sums of the ordered sizes -> (smallest feasible capacity, ends of its greedy shards).

    A capacity of total / shards + largest always does: each greedy shard but the last then holds over
    total / shards.
    """
    low = max(largest, -(-total // shards))
    high = min(total, -(-total // shards) + largest)
    best: tuple[int, list[int]] = (-1, [])
    while low < high:
        step = max(1, -(-(high - low) // (PROBES + 1)))
        tried = sorted({min(high - 1, low + step * i) for i in range(PROBES)})
        fills = _fill(groups, tried, shards, total)
        good = next((i for i, f in enumerate(fills) if f[-1] >= total), len(tried))
        if good < len(tried):
            high, best = tried[good], (tried[good], fills[good])
        if good:
            low = tried[good - 1] + 1
    if best[0] != high:
        best = (high, _fill(groups, [high], shards, total)[0])
    return high, best[1][1:]


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null), group_first, capacity.

    size is the text's UTF-8 bytes plus 1 (null: 1; null and empty texts are equal). Documents of equal
    text go to one shard, so no shard can be smaller than the largest group; the capacity returned is
    the least possible for whole groups in order. slot numbers a shard's rows from 0 by doc_id, then
    text; null doc_ids come first and repeated rows get slots of their own. An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    parts = 2 * parallelism(spark)
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    base = scratch.write(base, "base")
    groups = base.groupBy("key").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first"))
    groups = scratch.write(groups.withColumn("b", bucket(F.col("first"), bounds(groups, "first", parts))), "sized")
    sums = groups.groupBy("b").agg(F.sum("bytes").alias("s"), F.max("bytes").alias("m"))
    total, largest = sums.agg(F.sum("s"), F.max("m")).first()
    if total is None:
        return base.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("doc_id").alias("group_first"), F.col("size").alias("capacity"))
    # one row a bucket, at most ``parts``
    offsets = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("bytes").over(Window.partitionBy("b").orderBy("first", "key").rowsBetween(Window.unboundedPreceding, 0))
    table = scratch.write(groups.withColumn("w", within).join(F.broadcast(offsets), "b").select("key", "first", (F.col("w") + F.col("before")).alias("upto")), "groups")
    capacity, ends = smallest_cuts(table.select("upto"), shards, total, largest)
    place = F.lit(0)
    for end in ends[:-1]:
        place = place + F.when(F.col("upto") > F.lit(end).cast("long"), 1).otherwise(0)
    dealt = base.join(table.select("key", "first", place.cast("int").alias("shard")), "key")
    dealt = scratch.write(dealt.withColumn("b", bucket(F.col("doc_id"), bounds(base, "doc_id", parts))), "dealt")
    counts = dealt.groupBy("shard", "b").count()
    # at most shards x parts rows
    earlier = counts.select("shard", "b", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "b").orderBy("doc_id", "key")) - 1
    return dealt.withColumn("rank", rank).join(F.broadcast(earlier), ["shard", "b"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("first").alias("group_first"), F.lit(capacity).cast("long").alias("capacity"))
