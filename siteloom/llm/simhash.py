"""SimHash near-duplicates, linked through the anchors of a covering code.

Anchors: the code words of two binary Golay codes of length 23, laid on bits 0-22 and 23-45 of the
fingerprint. The Golay code is perfect: every 23-bit word lies within 3 bits of exactly one code word,
so every fingerprint has one home anchor. A fingerprint at t or fewer bits from another lies within
(3 + a, 3 + b), a + b <= t, of that one's home. Each fingerprint is therefore sent home once and, as a
visitor, to every anchor within reach; those that meet at an anchor are compared in full. No pair
within the threshold is missed, and each is found exactly once, at the home of its lesser fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch, free, ordered, parallelism
from siteloom.llm.components import connected_components
from siteloom.llm.jaccard import LOWER, similar_components

# Fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 for a text without words."""
    import xxhash

    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return 0
    joined, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    k = min(words, len(found))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit integer. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _remainder(word: np.ndarray | int) -> np.ndarray | int:
    for bit in range(22, 10, -1):
        word = word ^ (((word >> bit) & 1) * (GOLAY << (bit - 11)))
    return word


@lru_cache(maxsize=4)
def _patterns(reach: int) -> list[list[np.ndarray]]:
    """[excess][syndrome] -> the error patterns of weight 3 + excess (excess 0: 3 or less)."""
    out: list[list[list[int]]] = [[[] for _ in range(2048)] for _ in range(reach + 1)]
    for weight in range(3 + reach + 1):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], dtype=np.int64)
        for e, s in zip(errors.tolist(), np.asarray(_remainder(errors)).tolist()):
            out[max(0, weight - 3)][s].append(e)
    return [[np.array(x, dtype=np.int64) for x in level] for level in out]


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within reach of each fingerprint; threshold 0: its home alone."""
    tables = _patterns(threshold)
    low, high = (fps & 0x7FFFFF).astype(np.int64), ((fps >> 23) & 0x7FFFFF).astype(np.int64)
    rows, found = [], []
    for i, (a, b, s, t) in enumerate(zip(low, high, np.asarray(_remainder(low)), np.asarray(_remainder(high)))):
        for x in range(threshold + 1):
            left = a ^ tables[x][s]
            for y in range(threshold + 1 - x):
                own = (left[:, None] | ((b ^ tables[y][t]) << 23)[None, :]).ravel()
                found.append(own)
                rows.append(np.full(len(own), i))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _sent(fps: DataFrame, threshold: int, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                own = part.column(0).to_numpy()
                rows, at = anchors(own, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[rows])], names=["anchor", name])

    return fps.select("fp").mapInArrow(run, f"anchor long, {name} long")


def links(fps: DataFrame, threshold: int) -> DataFrame:
    """Distinct fingerprints (fp) -> every pair (a, b), a < b, at threshold or fewer differing bits, once."""
    home, visit = _sent(fps, 0, "a"), _sent(fps, threshold, "b")
    # visitors are many times the fingerprints, which Spark's estimate can't know: neither side may be sent to all tasks
    return home.hint("merge").join(visit, (home.anchor == visit.anchor) & (home.a < visit.b) & (F.bit_count(home.a.bitwiseXOR(visit.b)) <= threshold)).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable over links.

    Fingerprints that are equal or differ in at most ``threshold`` bits link. Copies share one
    fingerprint and one node of the graph, so a group of copies costs no pairs. Texts without words
    (null, empty, blank) have fingerprint zero and link like any other. Rows with a null doc_id keep
    their fingerprint, have a null component_id and link nothing. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs.select("doc_id", "text"), words), "fps")
    reps = scratch.write(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    pairs = scratch.write(links(reps.repartition(parallelism(docs.sparkSession), "fp"), threshold), "links")
    one = pairs.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("u")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("v")), "b")
    found = connected_components(one.select("u", "v"), scratch)
    named = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = scratch.write(named, "named")
    return fps.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# Whole-document similarity. Fingerprints of the sets of shingles within BITS_APART bits, found over the anchors, are
# candidates, and verified. As no number of bits holds for every pair at a similarity of ``least``, the exact join
# over count vectors (jaccard) then finds the rest.
BITS_APART = 2


def set_fingerprint(own: np.ndarray) -> int:
    """64-bit SimHash of a set of shingle hashes, as a signed integer; 0 for none."""
    if not len(own):
        return 0
    bits = np.unpackbits(own.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(own)).view(">i8")[0])


def fingerprint_candidates(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """sets (rep, fp) -> pairs (u, v) of sets with equal fingerprints, or such within BITS_APART bits by the anchors.

    Sets of one fingerprint are paired with the least of them only, so that copies cost rows in proportion.
    """
    heads = scratch.write(sets.groupBy("fp").agg(F.min("rep").alias("head")), "heads")
    same = sets.join(heads, "fp").where("rep <> head").select(F.col("rep").alias("u"), F.col("head").alias("v"))
    near = links(heads.repartition(parallelism(sets.sparkSession), "fp"), BITS_APART)
    side = lambda c, name: heads.select(F.col("fp").alias(c), F.col("head").alias(name))
    far = near.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    return same.unionAll(far)


def distinct_documents(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The document of least doc_id of each group of near copies, with all columns, whatever their names.

    Near copies are linked where the similarity of their sets of five-word shingles is ``least`` or more;
    every such pair is linked, or connected by others, and no other pair is linked; groups are closed
    over links. Texts without words (null, empty, blank) are copies of each other. Rows with equal or
    null doc_ids are told apart by (doc_id, text), nulls first. An empty table gives an empty table.
    """
    scratch, order = Scratch(docs.sparkSession, "distinct"), free(docs, "order_at")
    every = ordered(docs, scratch, order)
    keys, named = similar_components(every.select(F.col(order).alias("row_at"), "text"), words, Fraction(least).limit_denominator(10_000), scratch, set_fingerprint, fingerprint_candidates)
    wordless = keys.where("n = 0").groupBy("key", "n").agg(F.min("row_at").alias("component"))
    stays = named.select("key", "n", "component").unionAll(wordless)
    gone = scratch.write(keys.join(stays, ["key", "n"]).where("row_at <> component").select("row_at"), "gone")
    return every.join(gone.withColumnRenamed("row_at", order), order, "left_anti").select(*docs.columns)
