"""Shared helpers of the corpus operators: scratch tables, range buckets, broadcast files."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.shared import own_folder, remove


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of rows that go to a Python worker at once. Spark's 64 MB of texts are held several times over, by the JVM and by Python.
BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python BATCH bytes at a time, unless the session has a limit of its own. The setting stays, as plans run after the call."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH))


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A written table cuts lineage and survives lost executors. ``drop`` removes a table that no later
    plan reads; the rest goes when the application ends. Operators that have one also send bounded batches.
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = own_folder(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))


def free(docs: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while stem in taken:
        stem += "_"
    return stem


def bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts-1 ascending values of an integer column that cut it into ranges of similar counts.

    Every value returned occurs in the column, so no range but the first can be empty, and the first
    is not empty either, as the smallest value is never returned. Only these few values reach the driver.
    """
    if parts < 2:
        return []
    row = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 20 * parts).alias("q"), F.min(column).alias("lo")).first()
    return [] if row["q"] is None else sorted({int(x) for x in row["q"] if x > row["lo"]})


def bucket(column: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the value; nulls go to bucket 0."""
    if not cuts:
        return F.lit(0)
    array = F.expr("array(" + ",".join(f"{c}L" for c in cuts) + ")")
    return F.coalesce(F.size(F.filter(array, lambda c: c <= column)), F.lit(0))


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of jobs whose results are already written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ordered(docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Adds a unique integer column, whose name must be free, that ascends with doc_id.

    It is doc_id itself where that is unique and never null. Otherwise rows are numbered by
    (doc_id, text), nulls first, and the numbered table is written, so that later reads agree.
    """
    worst = docs.groupBy("doc_id").count().agg(F.max(F.when(F.col("doc_id").isNull(), 2).otherwise(F.col("count")))).first()[0]
    if worst is None or worst == 1:
        return docs.withColumn(name, F.col("doc_id"))
    dealt = docs.repartitionByRange(parallelism(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.write(dealt.withColumn(name, F.monotonically_increasing_id()), "ordered")
