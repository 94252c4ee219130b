"""Incremental scoring: a file stream of manifest rows into a table without repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteloom.operators.sites import MODEL_KEY, keep_first
from siteloom.sources.sinks import append_new


def follow(spark: SparkSession, path: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: tuple[str, ...] = MODEL_KEY) -> StreamingQuery:
    """Reads what has arrived at ``path``, works on rows whose key ``out`` lacks, and appends; then stops.

    The checkpoint makes each file count once; the key check makes a batch that is run again harmless.
    """

    def batch(rows: DataFrame, _: int) -> None:
        append_new(work(keep_first(rows, list(keys), [F.to_json(F.struct(*rows.columns))])), out, keys)

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
