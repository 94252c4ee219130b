"""Running totals over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, *keys: str) -> Column:
    """A reproducible order of keys: the md5 of the seed and the keys, joined by dashes."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


#: Keys that are looked at to place the cuts, for each range.
LOOKED_AT = 20


def ranges(rows: DataFrame, order: list[str], name: str = "range_at") -> DataFrame:
    """Adds the number of the range of ``order`` that a row lies in; ranges ascend and hold similar numbers of rows.

    The cuts come from a few rows a range; they decide how even the ranges are, never a result. Equal keys
    share a range.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = rows.count()
    if parts == 1 or n < 10_000:
        return rows.withColumn(name, F.lit(0))
    share = min(1.0, LOOKED_AT * parts / n)
    seen = rows.select(*order).sample(share, seed=5).orderBy(*order).limit(4 * LOOKED_AT * parts).collect()
    step = max(1, len(seen) // parts)
    cuts = spark.createDataFrame(seen[step::step], rows.select(*order).schema)
    key = lambda c: F.struct(*(F.col(x) for x in c))
    table = cuts.agg(F.collect_list(key(order)).alias("cut_list"))  # at most a cut a range, one row
    return rows.crossJoin(F.broadcast(table)).withColumn(name, F.size(F.filter("cut_list", lambda c: c <= key(order)))).drop("cut_list")


def running(rows: DataFrame, order: list[str], value: Column, name: str, how: str = "sum") -> DataFrame:
    """Adds the sum, max or min of ``value`` over all rows up to and with a row's own, in order.

    ``order`` tells all rows apart. Each range is worked on in a task of its own; what all ranges before it
    come to is a table of a row a range.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "max": F.greatest, "min": F.least}[how]
    placed = ranges(rows.withColumn("range_value", value), order)
    before = Window.orderBy("range_at").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = placed.groupBy("range_at").agg(fold("range_value").alias("range_total")).select("range_at", fold("range_total").over(before).alias("range_before"))
    own = fold("range_value").over(Window.partitionBy("range_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("range_own", own).join(F.broadcast(totals), "range_at").withColumn(name, both(F.col("range_before"), F.col("range_own"))).drop("range_at", "range_value", "range_own", "range_before")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in order, from 0; ``order`` tells all rows apart."""
    return running(rows, order, F.lit(1).cast("long"), name).withColumn(name, (F.col(name) - 1).cast("long"))
