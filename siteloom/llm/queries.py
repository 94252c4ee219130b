"""The corpus operators as queries over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siteloom.llm import decontaminate, hmm, importance, jaccard, license_scan, negatives, pieces, quality, sharding, simhash, sketch, suffix_dedup, token_file
from siteloom.llm.common import documents


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(documents(spark, sf_dir))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_table(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.neighbours(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 8)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("detections")


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_documents(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.with_noisy_labels(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_suffix_dedup, op3_token_file, op4_simhash_components, op5_quality, op6_sketch, op7_sentencepiece, op8_sharding, op9_license_scan, op10_hidden_markov, op11_jaccard_join, op12_hard_negatives, op13_importance, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op12_hard_negatives": negatives.SQL, "op13_importance": importance.SQL}
