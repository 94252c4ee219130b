"""Checks over tables: each gives counts or the offending rows, so that a run can report or stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def disagreements(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """DQ1, DQ2: how many rows there are, and in how many the two columns differ or one is missing."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~a.eqNullSafe(b)).alias("n_disagree"))


def shared_between(rows: DataFrame, key: str, group: str) -> DataFrame:
    """DQ4: keys that occur in more than one group."""
    return rows.groupBy(key).agg(F.min(group).alias("lo"), F.max(group).alias("hi")).where("lo <> hi").select(key)


def foreign(rows: DataFrame, pool: DataFrame, on: list[str]) -> DataFrame:
    """DQ3: how many rows have a key that isn't in the pool."""
    return rows.join(pool.select(*on).distinct(), on, "left_anti").agg(F.count("*").alias("n_foreign"))


def in_one_part(parts: list[DataFrame], group: list[str]) -> DataFrame:
    """DQ7: how many groups the parts have, and how many of these are in one part only."""
    tagged = [p.select(*group).distinct().withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    every = tagged[0]
    for p in tagged[1:]:
        every = every.unionAll(p)
    return every.groupBy(*group).count().agg(F.count("*").alias("n_groups"), F.count_if(F.col("count") == 1).alias("n_in_one_shard"))
