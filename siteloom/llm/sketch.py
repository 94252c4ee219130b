"""Threshold-scaled sketches of word shingles, in DataFrame expressions only.

Kept are all shingle hashes in the lowest 1/2^bits of the 64-bit range, and the least hash in any case,
so that no text with words has an empty sketch. Sketches of unequal sizes compare without loss, and the
union of two sketches is, but for the extra least hash, the sketch of the union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch, bounds, bucket, ordered, parallelism

WORDS = 5
BITS = 4


def with_sketch(rows: DataFrame, text: str, name: str, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Adds the ascending array of kept hashes; empty for a text without words.

    Words are split at ASCII white space and their case counts; a text of fewer words than a shingle has
    one shingle, the whole sequence.
    """
    hashed = rows.withColumn("trimmed_", F.trim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))).withColumn("h_", F.transform(F.when(F.col("trimmed_") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed_", r"[\x20\x09-\x0D]+")), lambda w: F.xxhash64(w)))
    each = ", ".join(f"h_[i + {k}]" for k in range(words))
    shingles = F.expr(f"""case when size(h_) = 0 then cast(array() as array<bigint>)
        when size(h_) < {words} then array(xxhash64(h_))
        else transform(sequence(0, greatest(size(h_) - {words}, 0)), i -> xxhash64({each})) end""")
    low = -(1 << 63) + (1 << (64 - bits))
    kept = F.expr(f"if(size(s_) = 0, s_, array_sort(array_union(array(array_min(s_)), filter(s_, h -> h < {low}L))))")
    return hashed.withColumn("s_", shingles).withColumn(name, kept).drop("trimmed_", "h_", "s_")


def as_text(sketch: str) -> Column:
    """Kept hashes in ascending order, 16 hex digits each."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Containment of the smaller sketch in the larger: 1 for two without hashes, 0 if only one has none."""
    least = F.least(F.size(a), F.size(b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def neighbours(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the start of the next document's (ascending doc_id, after the last the
    first): floor(n_chars / 2) code points are replaced by as many, or all it has. Null texts are empty.
    Rows with equal or null doc_ids are ordered by (doc_id, text), nulls first. A single document is its
    own next. An empty table gives an empty table.

    The order is cut into ranges of doc_id by sampled bounds; a copy of each range's first row closes
    the range before it, so that looking ahead never needs all rows in one task.
    """
    spark = docs.sparkSession
    rows = ordered(docs.select("doc_id", "text"), Scratch(spark, "sketch"), "order_at").withColumn("text", F.coalesce("text", F.lit("")))
    cuts = bounds(rows, "order_at", 4 * parallelism(spark))
    least = rows.agg(F.min("order_at")).first()[0]
    sketched = with_sketch(rows, "text", "sketch", words, bits)
    part = bucket(F.col("order_at"), cuts)
    heads = sketched.where(F.col("order_at").isin([*cuts, *([least] if least is not None else [])]))
    n = len(cuts) + 1
    both = sketched.withColumn("part", part).withColumn("head", F.lit(0)).unionAll(heads.withColumn("part", (part + (n - 1)) % n).withColumn("head", F.lit(1)))
    ahead = Window.partitionBy("part").orderBy("head", "order_at")
    paired = both.withColumn("next_text", F.lead("text").over(ahead)).withColumn("next_sketch", F.lead("sketch").over(ahead)).where("head = 0")
    paired = paired.withColumn("n_chars", F.char_length("text").cast("long"))
    paired = paired.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    done = with_sketch(paired.select("doc_id", "n_chars", "sketch", "next_sketch", "edited"), "edited", "edited_sketch", words, bits)
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"))
