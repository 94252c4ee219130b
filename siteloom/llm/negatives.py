"""Hard negatives by exact inner products, searched in buckets of vectors of similar length.

Vectors are sorted by length into buckets, and those of a label and bucket packed into blocks. Anchors
form groups of bounded size; a group meets the blocks it needs, dealt over lanes, longest vectors first.
By Cauchy-Schwarz no score of an anchor a in a block is above |a| times the block's greatest length: a
bucket that can't reach the lower limit of any of the group's windows isn't sent to it, and a block that
can't reach an anchor's limit or its running k-th score is passed over. Nothing else is left out, so the
result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch, parallelism

#: Anchors of a group, vectors of a block, buckets of length.
GROUP, BLOCK, BUCKETS = 1024, 1024, 16
#: Scores of lengths up to this product are exact in doubles.
EXACT = 2.0**53
LONG = 2**63 - 1
ROW = "label long, bucket int, top double, anchor boolean, row_at array<long>, vec_id array<long>, size array<int>, vector array<double>"
NEEDS = "need_rank array<int>, need_id array<long>, low array<long>, high array<long>"


def scaled(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, length, vector) of the rows that take part, components floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, length, own = [], [], []
            for i, x in enumerate(batch.column(2).to_pylist()):
                v = np.floor(scale * np.array(x, np.float64)) if x is not None and None not in x else np.array([np.nan])
                if np.isfinite(v).all():
                    keep.append(i)
                    own.append(v)
                    length.append(float(np.sqrt((v * v).sum())) * (1 + 1e-12))  # never below the true one
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(length, pa.float64()), pa.array(own, pa.list_(pa.float64()))], names=["vec_id", "label", "length", "vector"])

    used = rows.where("vec_id is not null and label is not null and embedding is not null")
    return used.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, "vec_id long, label long, length double, vector array<double>")


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of at most BLOCK rows of one label and bucket, made by each task from what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def block() -> pa.RecordBatch:
            vectors = [r[5] for r in held]
            columns = ([key[0]], [key[1]], [max(r[4] for r in held)], [False], [[r[2] for r in held]], [[r[3] for r in held]], [[len(v) for v in vectors]], [np.concatenate(vectors)])
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["label", "bucket", "top", "anchor", "row_at", "vec_id", "size", "vector"])

        for batch in batches:
            vectors = batch.column(5)
            for i, r in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if key != r[:2] or len(held) == BLOCK:
                    if held:
                        yield block()
                    held, key = [], r[:2]
                held.append((*r, vectors[i].values.to_numpy()))
        if held:
            yield block()

    dealt = rows.sortWithinPartitions("label", "bucket").select("label", "bucket", "row_at", "vec_id", "length", "vector")
    return dealt.mapInArrow(run, ROW)


def matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


class Search:
    """The best k candidates of some anchors, or of each of their windows, as blocks come in."""

    def __init__(self, k: int, other_label: bool):
        self.k, self.other_label, self.anchors, self.ready = k, other_label, [], False

    def add(self, row: dict) -> None:
        self.anchors.append(row)

    def start(self) -> None:
        """Needs are (anchor, low, high); a search without windows has one for each anchor."""
        every, self.ready = self.anchors, True
        self.rows, self.ids = (np.array([x[c][0] for x in every], np.int64) for c in ("row_at", "vec_id"))
        self.labels, self.lengths = np.array([x["label"] for x in every], np.int64), np.array([x["top"] for x in every])
        self.vectors = matrix([np.asarray(x["vector"]) for x in every])
        if self.other_label:
            self.of = np.repeat(np.arange(len(every)), [len(x["low"]) for x in every])
            self.ranks, self.partners, self.low, self.high = (np.concatenate([np.asarray(x[c], np.int64) for x in every]) for c in ("need_rank", "need_id", "low", "high"))
        else:
            self.of, (self.low, self.high) = np.arange(len(every)), np.array([[-LONG - 1], [LONG]]) * np.ones(len(every), np.int64)
        self.needed = self.low.copy()  # a candidate below this can't be among the best k
        self.best = [np.zeros(0, np.int64) for _ in range(3)]  # need, score, candidate

    def scores(self, anchors: np.ndarray, vectors: np.ndarray, top: float) -> np.ndarray:
        a, b, wide = self.vectors[anchors], vectors, max(self.vectors.shape[1], vectors.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
        if float(self.lengths[anchors].max()) * top < EXACT:
            return (a @ b.T).astype(np.int64)
        whole = [[int(x) for x in row] for row in b]
        return np.array([[max(-LONG, min(LONG, sum(int(x) * y for x, y in zip(row, other)))) for other in whole] for row in a], np.int64)

    def feed(self, row: dict) -> None:
        top = row["top"]
        open_ = self.lengths[self.of] * top >= self.needed.astype(np.float64)
        if self.other_label:
            open_ &= self.labels[self.of] != row["label"]
        needs = np.flatnonzero(open_)
        if not len(needs):
            return
        sizes = row["size"]
        vectors = matrix(np.split(row["vector"], np.cumsum(sizes)[:-1]))
        anchors, where = np.unique(self.of[needs], return_inverse=True)
        every = self.scores(anchors, vectors, top)
        for some in np.array_split(np.arange(len(needs)), -(-len(needs) // GROUP)):  # bounded memory, however many windows
            own, need = every[where[some]], needs[some]
            good = (own >= self.needed[need][:, None]) & (own <= self.high[need][:, None])
            if not self.other_label:
                good &= self.rows[self.of[need]][:, None] != row["row_at"][None, :]
            if own.shape[1] > self.k:
                kth = np.partition(np.where(good, own, -LONG - 1), -self.k, axis=1)[:, -self.k]
                good &= own >= kth[:, None]
            x, y = np.nonzero(good)
            self.merge(need[x], own[x, y], row["vec_id"][y])

    def merge(self, need: np.ndarray, score: np.ndarray, candidate: np.ndarray) -> None:
        need, score, candidate = (np.concatenate(x) for x in zip(self.best, (need, score, candidate)))
        order = np.lexsort((candidate, -score, need))
        need, score, candidate = need[order], score[order], candidate[order]
        place = np.arange(len(need)) - np.searchsorted(need, need)
        kept = place < self.k
        self.best = [need[kept], score[kept], candidate[kept]]
        last = place == self.k - 1
        self.needed[need[last]] = np.maximum(self.low[need[last]], score[last])

    def found(self) -> pa.RecordBatch:
        need, score, candidate = self.best
        of = self.of[need]
        rank, partner = (self.ranks[need], self.partners[need]) if self.other_label else (np.zeros(len(need), np.int64),) * 2
        columns = (self.rows[of], self.ids[of], rank.astype(np.int32), partner, candidate, score)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row_at", "anchor_id", "need_rank", "need_id", "vec_id", "score"])


def searched(met: DataFrame, k: int, other_label: bool) -> DataFrame:
    """met (place, lane, anchor or block) -> the best k of each lane; rows of a place and lane come anchors first, then by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, search = None, Search(k, other_label)
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(names)}
                row = {c: (None if x.values is None else x.values.to_numpy(zero_copy_only=False)) if pa.types.is_list(x.type) else x.as_py() for c, x in row.items()}
                if at != (row["place"], row["lane"]):
                    if search.ready:
                        yield search.found()
                    at, search = (row["place"], row["lane"]), Search(k, other_label)
                if row["anchor"]:
                    search.add(row)
                elif search.anchors:
                    if not search.ready:
                        search.start()
                    search.feed(row)
        if search.ready:
            yield search.found()

    dealt = met.repartition("place", "lane").sortWithinPartitions("place", "lane", F.desc("anchor"), F.desc("top"), "row_at")
    return dealt.mapInArrow(run, "row_at long, anchor_id long, need_rank int, need_id long, vec_id long, score long")


def best(found: DataFrame, k: int, *key: str) -> DataFrame:
    """The first k of each key over all lanes, which have k rows of it at most; adds rank."""
    over = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def met(anchors: DataFrame, sides: DataFrame, blocks: DataFrame, on: list[str], place: Column, lanes: int) -> DataFrame:
    """The rows that meet: each group's anchors on every lane, and the blocks that ``sides`` (place, on) names for it, each on one."""
    names = ["label", "top", "anchor", "row_at", "vec_id", "size", "vector", *[c for c in anchors.columns if c in ("need_rank", "need_id", "low", "high")]]
    own = anchors.select(place.alias("place"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), *names)
    lane = F.pmod(F.xxhash64(F.col("row_at")[0]), F.lit(lanes)).cast("int")
    there = blocks.join(sides, on).withColumn("lane", lane)
    return own.unionByName(there.select("place", "lane", *[c for c in names if c in blocks.columns]), allowMissingColumns=True)


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, lowest: int = 80, highest: int = 100, scale: float = 256) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    rows has vec_id, embedding and label. Rows with a null among them, or a null or non-finite component
    (also once scaled), take no part. A component x counts as floor(scale * x); scores are integer inner
    products, higher ones first, ties by smaller vec_id; of vectors of different sizes the shorter is
    filled up with zeros; a score beyond 64 bits counts as the largest that fits. Anchors are the rows
    whose vec_id is divisible by ``every``; an anchor's positives are its first ``positives`` other rows
    of its label. For each, the first ``negatives`` rows of another label follow whose score is from
    ``lowest`` to ``highest`` per cent of the positive's. Repeated rows are rows of their own: they may
    be each other's positives, and their results repeat. Other columns are ignored, so none can clash. An
    empty table gives an empty table.
    """
    spark = rows.sparkSession
    scratch, wide = Scratch(spark, "negatives"), 2 * parallelism(spark)
    own = scratch.write(scaled(rows, scale).withColumn("row_at", F.monotonically_increasing_id()), "own")
    cuts = own.agg(F.percentile_approx("length", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("q")).first()["q"] or []
    bucket = sum((F.col("length") < c).cast("int") for c in sorted(set(cuts))) if cuts else F.lit(0)  # bucket 0 has the longest
    blocks = scratch.write(packed(own.withColumn("bucket", bucket)), "blocks")
    asked = own.where(F.col("vec_id") % every == 0)
    asked = asked.select("label", F.col("length").alias("top"), F.lit(True).alias("anchor"), F.array("row_at").alias("row_at"), F.array("vec_id").alias("vec_id"), F.array(F.size("vector")).alias("size"), "vector")
    # positives: groups of anchors of one label, which meet all blocks of that label
    counts = asked.groupBy("label").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    grouped = scratch.write(asked.join(counts, "label").withColumn("part", F.pmod(F.xxhash64(F.col("row_at")[0]), F.col("groups"))).drop("groups"), "anchors")
    sides = scratch.write(grouped.select("label", "part").distinct(), "groups")
    place = F.concat_ws("-", "label", "part")
    lanes = max(1, wide // max(1, sides.count()))
    same = searched(met(grouped, sides.withColumn("place", place), blocks, ["label"], place, lanes), positives, False)
    same = scratch.write(best(same, positives, "row_at").select("row_at", "rank", "vec_id", "score"), "positives")
    # negatives: groups of anchors of any label, which meet the blocks of every bucket that can reach a window
    need = F.struct(F.col("rank").alias("need_rank"), F.col("vec_id").alias("need_id"), F.ceil(F.col("score").cast("decimal(20,0)") * lowest / 100).cast("long").alias("low"), F.floor(F.col("score").cast("decimal(20,0)") * highest / 100).cast("long").alias("high"))
    windows = same.where("score >= 0").groupBy("row_at").agg(F.sort_array(F.collect_list(need)).alias("needs"))  # at most ``positives`` of an anchor
    windows = windows.select(F.array("row_at").alias("row_at"), *(F.col(f"needs.{c}").alias(c) for c in ("need_rank", "need_id", "low", "high")))
    wanted = grouped.join(windows, "row_at")
    groups = max(1, -(-wanted.count() // GROUP))
    wanted = scratch.write(wanted.withColumn("part", F.pmod(F.xxhash64(F.lit(7), F.col("row_at")[0]), F.lit(groups))), "wanted")
    tops = blocks.groupBy("bucket").agg(F.max("top").alias("longest"))  # a row a bucket
    reach = wanted.groupBy("part").agg(F.min(F.when(F.array_min("low") <= 0, 0.0).otherwise(F.array_min("low") / F.col("top"))).alias("least"))
    sides = reach.join(F.broadcast(tops), F.col("longest") * (1 + 1e-12) >= F.col("least")).select(F.col("part").cast("string").alias("place"), "bucket")
    found = searched(met(wanted, sides, blocks, ["bucket"], F.col("part").cast("string"), max(1, wide // groups)), negatives, True)
    found = best(found, negatives, "row_at", "need_rank")
    scores = same.select("row_at", F.col("rank").alias("need_rank"), F.col("score").alias("positive_score"))
    return found.join(scores, ["row_at", "need_rank"]).select("anchor_id", F.col("need_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def with_noisy_labels(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The label of each row whose vec_id is divisible by ``every`` becomes the next one."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, (row_number() OVER one)::INTEGER AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW one AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER one <= 5
"""
