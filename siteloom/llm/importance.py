"""Importance resampling towards a target distribution, over a sparse document-by-bucket count matrix.

Features (runs of words) are hashed into buckets. The counts are made as CSR blocks, each of some
documents: where a document's entries begin, their buckets, their counts. They are persisted with a row a
document, so that a reader holds some thousand documents and not some thousand blocks; the lists of a
batch that is read are a CSR block again, their offsets being where documents begin. Column sums of the matrix give
the corpus's distribution, those of the target's matrix the other; the logarithm of their ratio is a
bucket's gain, and the product of the matrix with the gains gives the documents' weights. Gumbel noise
that depends on doc_id alone makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch, parallelism

#: Documents of a block, and about how many entries it may have before it is closed.
ROWS, ENTRIES = 2000, 1 << 18
#: Buckets of words that a task remembers.
KNOWN = 1 << 18
BLOCK = "doc_id array<long>, n_words array<long>, n_features array<long>, starts array<long>, bucket array<int>, times array<int>"
ROW = "doc_id long, n_words long, n_features long, bucket array<int>, times array<int>"
#: Letters A-Z become small, digits, small letters and all bytes beyond ASCII stay, all else parts words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, none for null."""
    return (text or "").encode().translate(WORDS).split()


class Buckets(dict):
    """Feature (bytes) -> its bucket, the unsigned crc32 modulo their number."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def _counted(texts: DataFrame, key: str, longest: int, buckets: int, made: Callable, schema: str) -> DataFrame:
    """What ``made`` makes of each CSR block: (doc_id, n_words, n_features, starts, bucket, times)."""

    def block(keys: list, words: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in found], np.int64)
        row = np.repeat(np.arange(len(found)), sizes)
        cell, times = np.unique(row * buckets + np.concatenate(found), return_counts=True)
        starts = np.searchsorted(cell, np.arange(len(found) + 1) * buckets)
        return made(keys, words, sizes, starts, (cell % buckets).astype(np.int32), times.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        keys, words, found, held = [], [], [], 0
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = words_of(text.as_py())
                every = own if longest == 1 else [b" ".join(own[i : i + n]) for n in range(1, longest + 1) for i in range(len(own) - n + 1)]
                keys.append(k)
                words.append(len(own))
                found.append(np.fromiter(map(known.__getitem__, every), np.int64, len(every)))
                held += len(every)
                if len(keys) >= ROWS or held >= ENTRIES:
                    yield block(keys, words, found)
                    keys, words, found, held = [], [], [], 0
        if keys:
            yield block(keys, words, found)

    return texts.select(F.col(key).cast("long"), "text").mapInArrow(run, schema)


def count_blocks(texts: DataFrame, key: str, longest: int, buckets: int) -> DataFrame:
    """CSR blocks of a table of texts: in each, document i has the entries from starts[i] to starts[i + 1]."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    names = ["doc_id", "n_words", "n_features", "starts", "bucket", "times"]
    return _counted(texts, key, longest, buckets, lambda *own: pa.RecordBatch.from_arrays([pa.array([x], pa.list_(k)) for x, k in zip(own, kinds)], names=names), BLOCK)


def count_rows(texts: DataFrame, key: str, longest: int, buckets: int) -> DataFrame:
    """The same with a row a document."""

    def rows(keys: list, words: list[int], sizes: np.ndarray, starts: np.ndarray, bucket: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        entries = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x)) for x in (bucket, times)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.int64()), pa.array(sizes), *entries], names=["doc_id", "n_words", "n_features", "bucket", "times"])

    return _counted(texts, key, longest, buckets, rows, ROW)


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs, from blocks or rows. Each task adds up its own; at most ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, times = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            total += np.bincount(at, times, buckets).astype(np.int64)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.select("bucket", "times").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of target and corpus, by bucket."""
    b, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(y + 1) * (s + b)) / (float(x + 1) * (t + b)))) for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int, seed: int) -> int:
    """Gumbel noise in thousandths, from the document's id alone."""
    h = int(hashlib.sha256(b"%d:%d" % (seed, doc_id)).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(counts: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): the rows of counts, a batch at a time, times the gains, over the number of features."""
    sent = counts.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            at, times = (batch.column(c).flatten().to_numpy() for c in (3, 4))
            starts = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(3)).to_numpy())))
            upto = np.concatenate(([0], np.cumsum(sent.value[at] * times)))
            weight = np.where(n > 0, (upto[starts[1:]] - upto[starts[:-1]]) // np.maximum(n, 1), 0)
            score = [None if k is None else w + noise(k, seed) for k, w in zip(ids.to_pylist(), weight.tolist())]
            yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(weight), pa.array(score, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return counts.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def with_rank(scored: DataFrame, able: str, percent: int, scratch: Scratch) -> DataFrame:
    """Adds rank to the floor(percent * N / 100) highest scores of the N rows that ``able`` holds for, null elsewhere.

    Rows are sorted by range over all tasks and numbered within; a table of a row a range has how many lie before.
    """
    best = scored.where(able).repartitionByRange(parallelism(scored.sparkSession), F.desc("score"), "doc_id", "n_features", "n_words")
    best = best.sortWithinPartitions(F.desc("score"), "doc_id", "n_features", "n_words").withColumn("at", F.monotonically_increasing_id())
    best = scratch.write(best, "sorted")
    held = best.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"))
    before = held.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = best.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(before), "range").withColumn("rank", F.when(place <= F.floor(percent * F.col("total") / F.lit(100)), place))
    return ranked.select(*scored.columns, "rank").unionAll(scored.where(f"not ({able})").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """Every document's doc_id, n_features, weight, score, rank (1, 2, ... for those drawn, else null), all long.

    docs has doc_id and text, target has text; whole texts count, null ones have no words. Documents of
    fewer than ``least_words`` words are never drawn. Without features a weight is 0. Ties of the score
    go to the smaller doc_id. Repeated rows are documents of their own. A row with a null doc_id has a
    weight, but no noise: its score is null, it is never drawn and not among the N of which a share is
    drawn. Other columns of both tables are ignored, so none can clash. With an empty target all shares
    are smoothed evenly; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    counts = scratch.write(count_rows(docs, "doc_id", longest, buckets), "counts")
    wanted = count_blocks(target.select(F.lit(0).alias("doc_id"), "text"), "doc_id", longest, buckets)
    gain = gains(column_sums(counts, buckets), column_sums(wanted, buckets))
    scored = scratch.write(weights(counts, gain, seed), "scored")
    return with_rank(scored, f"doc_id is not null and n_words >= {least_words}", percent, scratch).drop("n_words")


SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
sides AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
texts AS (
  SELECT row_number() OVER () AS nr, side, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM sides),
counts AS (
  SELECT nr, side, word, count(*) AS n FROM (SELECT nr, side, unnest(words) AS word FROM texts) GROUP BY ALL),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counts)),
coded AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, [(16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT for i in range(length(h) // 2)]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc_table),
cells AS (SELECT nr, side, bucket, sum(n) AS n FROM counts JOIN coded USING (word) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM cells GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM sums),
gained AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM sums, totals),
summed AS (SELECT nr, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM cells JOIN gained USING (bucket) WHERE side = 0 GROUP BY nr),
scored AS (
  SELECT nr, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN summed USING (nr) WHERE side = 0),
drawn AS (
  SELECT nr, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank
FROM scored LEFT JOIN drawn USING (nr)
"""
