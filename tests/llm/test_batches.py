import pyarrow as pa
import pytest

from siteloom.llm import simhash, suffix_dedup
from siteloom.llm.common import BATCH

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    had = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    yield
    spark.conf.unset(LIMIT)
    if had is not None:
        spark.conf.set(LIMIT, had)


def largest(docs):
    """Bytes of the largest batch of rows that a Python worker gets."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["b"])

    return docs.select("text").mapInArrow(sizes, "b long").agg({"b": "max"}).first()[0]


@pytest.mark.parametrize("stage", [simhash.distinct_documents, suffix_dedup.cleaned_documents])
def test_texts_go_to_python_in_bounded_batches(spark, unset, stage):
    docs = spark.range(3000).selectExpr("id doc_id", "repeat(md5(cast(id as string)), 200) text").coalesce(1)  # 19 MB in one partition
    assert largest(docs) > 4 * BATCH
    stage(docs.limit(5))
    assert largest(docs) < BATCH + 20_000


def test_a_limit_of_the_session_stays(spark, unset):
    spark.conf.set(LIMIT, "1000000")
    suffix_dedup.cleaned_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert spark.conf.get(LIMIT) == "1000000"
