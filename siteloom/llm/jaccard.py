"""N-gram Jaccard join over count vectors in R-trees.

A text's set holds the distinct hashes of its word shingles. Hashed into d groups, a set is the point of
its group counts; two sets share at most the sum, over the groups, of the lesser count. An R-tree's node
keeps the greatest count of each group among its points, so the same sum bounds what any point below one
node can share with any below another, and nodes that can't reach the similarity are passed over together.
Pairs that survive are verified by their exact sets.

One tree over all texts would not do: the counts of unrelated texts differ little in any one group, so its
boxes overlap everywhere and every pair of leaves would be compared. Trees are therefore kept for the sets
that share a shingle, and only shingles of a set's prefix count: in one order of all shingles, common ones
last, similar sets share one of the first n - ceil(least * n) + 1 of each. No pair is missed by this.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch, free, ordered, release
from siteloom.llm.components import connected_components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles that a task counts at a time, how often one must be seen in these to be reported, and how many of the most
#: frequent are put last in the order. All three decide costs, never results.
COUNTED, SEEN, HOT = 2_000_000, 4, 1 << 18
#: Groups of a point: the power of two from the size of the set on, within these.
LEAST_GROUPS, MOST_GROUPS = 64, 1 << 14
#: Points of a leaf, children of a node, rows of a list that one task holds.
LEAF, FAN, SLICE = 64, 16, 8_192
#: A shingle reported so often is dealt in so many parts.
SALTED, SALTS = 20_000, 64
#: Words and sets that a task remembers.
KNOWN = 1 << 19


class Shingles(dict):
    """Word (bytes) -> its hash; calling it with a text gives the ascending distinct hashes of its shingles."""

    def __init__(self, words: int):
        import xxhash

        super().__init__()
        self.hash, self.words = xxhash.xxh3_64_intdigest, words
        self.factors = np.array([self.hash(b"%d" % i) | 1 for i in range(words)], np.uint64)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = self.hash(word)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        """A text of fewer words than a shingle has one, the whole sequence; without words it has none."""
        found = (text or "").encode().translate(LOWER).split()
        if not found:
            return np.zeros(0, np.int64)
        own, k = np.fromiter(map(self.__getitem__, found), np.uint64, len(found)), min(self.words, len(found))
        n = len(found) - k + 1
        mixed = np.full(n, k, np.uint64)
        for i in range(k):
            mixed += own[i : i + n] * self.factors[i]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return np.unique((mixed ^ (mixed >> np.uint64(29))).view(np.int64))


def set_key(own: np.ndarray) -> int:
    """With its size this stands for a set; equal sets have equal keys."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def needed(n, m, least: Fraction):
    """Shingles that sets of n and m must share at least (integers or integer arrays)."""
    return -((-least.numerator * (n + m)) // (least.numerator + least.denominator))


def prefix(own: np.ndarray, hot: np.ndarray, times: np.ndarray, least: Fraction) -> np.ndarray:
    """The first n - ceil(least * n) + 1 of a set by (times seen, hash); hot ascends, times has its counts."""
    if not len(own):
        return own
    weight = np.zeros(len(own), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        weight = np.where(hot[at] == own, times[at], 0)
    return own[np.argsort(weight, kind="stable")[: len(own) + (-least.numerator * len(own)) // least.denominator + 1]]


def set_keys(keyed: DataFrame, words: int, fingerprint=None) -> DataFrame:
    """keyed (row_at, text) -> a row (row_at, key, n, fp, point) for each text, and rows (token, times) for shingles seen often.

    Each task counts the shingles of some texts at a time and reports those it has seen SEEN times or more. All
    texts take part. fp is ``fingerprint`` of the set, if given.
    """
    names = ["row_at", "key", "n", "fp", "token", "times", "point"]

    def seen(held: list[np.ndarray]) -> pa.RecordBatch:
        token, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= SEEN
        nothing = [pa.nulls(int(often.sum()), pa.int64())] * 4
        return pa.RecordBatch.from_arrays([*nothing, pa.array(token[often]), pa.array(times[often]), pa.nulls(int(often.sum()), pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, size = Shingles(words), [], 0
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            rows, points = [], []
            for text in batch.column(1):
                own = shingles(text.as_py())
                points.append(packed(own))
                rows.append((set_key(own), len(own), fingerprint(own) if fingerprint else 0))
                held.append(own)
                size += len(own)
                if size >= COUNTED:
                    yield seen(held)
                    held, size = [], 0
            nothing = [pa.nulls(len(rows), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in zip(*rows)), *nothing, pa.array(points, pa.binary())], names=names)
        if held:
            yield seen(held)

    return keyed.select("row_at", "text").mapInArrow(run, ", ".join(f"{x} long" for x in names[:-1]) + ", point binary")


def prefix_rows(keyed: DataFrame, words: int, least: Fraction, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, key, n, pos, salt) for each shingle of each set's prefix; a task sends a set that it remembers once.

    salt is 0, but for the most frequent shingles, whose sets are dealt over parts from 1 on.
    """
    sent = keyed.sparkSession.sparkContext.broadcast(hot)  # HOT rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, known, crowded = Shingles(words), set(), sent.value[0][sent.value[1] >= SALTED]
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            keys, sizes, first = [], [], [np.zeros(0, np.int64)]
            for text in batch.column(0):
                own = shingles(text.as_py())
                key = set_key(own), len(own)
                if not len(own) or key in known:
                    continue
                if len(known) >= KNOWN:
                    known.clear()
                known.add(key)
                keys.append(key)
                first.append(prefix(own, *sent.value, least))
                sizes.append(len(first[-1]))
            own = np.repeat(np.array(keys, np.int64).reshape(-1, 2), sizes, axis=0)
            pos, token = np.concatenate([np.arange(s) for s in (0, *sizes)]).astype(np.int64), np.concatenate(first)
            salt = np.where(np.isin(token, crowded), own[:, 0] % SALTS + 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, own[:, 0], own[:, 1], pos, salt)], names=["token", "key", "n", "pos", "salt"])

    return keyed.select("text").mapInArrow(run, "token long, key long, n long, pos long, salt long")


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, salt, n, key, pos) in this order -> the distinct rows of tokens with two sets or more, each with the first of its token.

    Rows pass through; but for the last one nothing is held, however many share a token. Rows with a salt are all
    kept, as their token has other parts, and have the first of their part.
    """
    names, held = ["token", "salt", "n", "key", "pos", "first_n", "first_key", "first_pos"], None
    for batch in chain(batches, (None,)):
        own = [np.zeros(0, np.int64)] * 5 if batch is None else [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if held is not None:
            own = [np.concatenate((h, x)) for h, x in zip(held[0], own)]
        new = np.ones(len(own[0]), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in own[:4]], axis=0)
        own = [x[new] for x in own]
        token, salt = own[:2]
        if not len(token):
            continue
        same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        start = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(token)), 0))
        first = [x[start] for x in own[2:]]
        company = np.concatenate(([False], same)) | (salt > 0)
        if held is not None:
            company[0] |= held[2]
            for x, h in zip(first, held[1]):
                x[start == 0] = h
        kept = company.copy()
        kept[:-1] |= same
        if batch is not None:  # the last row waits for its successor
            held = [x[-1:] for x in own], [int(x[-1]) for x in first], bool(company[-1])
            kept[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (*own, *first)], names=names)


def packed(own: np.ndarray) -> bytes:
    """The point of a set: counts of its shingles by group, at most 15 each, two to a byte. What is beyond counts as over (see Tree)."""
    groups = min(MOST_GROUPS, max(LEAST_GROUPS, 1 << max(0, len(own) - 1).bit_length()))
    counts = np.minimum(np.bincount(own & (groups - 1), minlength=groups), 15).astype(np.uint8)
    return (counts[: groups // 2] | (counts[groups // 2 :] << 4)).tobytes()


def counts_of(point: bytes) -> np.ndarray:
    both = np.frombuffer(point, np.uint8)
    return np.concatenate((both & 15, both >> 4))


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Counts (along the last axis) in fewer groups: groups are low bits of a hash, so halves are added."""
    while counts.shape[-1] > groups:
        half = counts.shape[-1] // 2
        counts = counts[..., :half].astype(np.uint32) + counts[..., half:]
    return counts


@dataclass
class Node:
    """A box of points: the greatest count of each group, the ranges of sizes and components, the most that is over."""

    most: np.ndarray
    n: tuple[int, int]
    component: tuple[int, int]
    over: int
    below: list[Node] | slice

    def side(self) -> int:
        return 0 if isinstance(self.below, slice) else len(self.below)


class Tree:
    """An R-tree over the points of a list, packed by number of groups, component and size.

    Sets of one component are close to each other, so packing by component keeps boxes small.
    """

    def __init__(self, rep: np.ndarray, component: np.ndarray, n: np.ndarray, points: list[np.ndarray], least: Fraction):
        width = np.array([len(p) for p in points])
        order = np.lexsort((n, component, width))
        self.rep, self.component, self.n, self.least = rep[order], component[order], n[order], least
        width, points, self.group = width[order], [points[i] for i in order], self.component.copy()
        self.over = self.n - np.array([int(p.sum()) for p in points])
        self.roots = []
        for groups in np.unique(width):  # a tree for each number of groups
            a, b = np.searchsorted(width, groups), np.searchsorted(width, groups, side="right")
            counts = np.stack(points[a:b])
            level = [self.leaf(counts[i - a : i - a + LEAF], slice(i, min(i + LEAF, b))) for i in range(a, b, LEAF)]
            while len(level) > 1:
                level = [self.node(level[i : i + FAN]) for i in range(0, len(level), FAN)]
            self.roots.append((counts, int(a), level[0]))

    def leaf(self, counts: np.ndarray, rows: slice) -> Node:
        n, c = self.n[rows], self.component[rows]
        return Node(counts.max(axis=0), (int(n.min()), int(n.max())), (int(c.min()), int(c.max())), int(self.over[rows].max()), rows)

    def node(self, below: list[Node]) -> Node:
        ends = lambda x: (min(b[0] for b in x), max(b[1] for b in x))
        return Node(np.max([b.most for b in below], axis=0), ends([b.n for b in below]), ends([b.component for b in below]), max(b.over for b in below), below)

    def pairs(self, other: Tree | None = None, forest: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The pairs, by rep, of two components that may reach the similarity: within this tree, or with another's points.

        For a forest, a pair is left out if pairs found before it would join its components, if all of them hold.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        self.forest = forest
        mine, theirs = self.roots, (other or self).roots
        for i, x in enumerate(mine):
            for y in theirs if other else mine[i:]:
                if max(len(x[2].most), len(y[2].most)) <= 2 * min(len(x[2].most), len(y[2].most)):
                    self.meet(x, y, x[2], y[2], other or self, found)
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in (0, 1))

    def meet(self, x: tuple, y: tuple, a: Node, b: Node, other: Tree, found: list) -> None:
        if a.component[0] == a.component[1] == b.component[0] == b.component[1]:
            return
        if a.n[1] < needed(a.n[1], b.n[0], self.least) or b.n[1] < needed(b.n[1], a.n[0], self.least):
            return  # the larger of one are too small for the least of the other
        groups = min(len(a.most), len(b.most))
        if int(np.minimum(folded(a.most, groups), folded(b.most, groups)).sum(dtype=np.int64)) + min(a.over, b.over) < needed(a.n[0], b.n[0], self.least):
            return
        if a is b and a.side():
            for i, c in enumerate(a.below):
                for d in a.below[i:]:
                    self.meet(x, y, c, d, other, found)
        elif a.side() or b.side():
            for c in a.below if a.side() >= b.side() else b.below:
                self.meet(x, y, *((c, b) if a.side() >= b.side() else (a, c)), other, found)
        else:
            self.compare(x, y, a, b, other, found)

    def compare(self, x: tuple, y: tuple, a: Node, b: Node, other: Tree, found: list) -> None:
        if self.forest and len(np.unique(np.concatenate((self.group[a.below], other.group[b.below])))) == 1:
            return
        groups = min(len(a.most), len(b.most))
        left = folded(x[0][a.below.start - x[1] : a.below.stop - x[1]], groups)
        right = folded(y[0][b.below.start - y[1] : b.below.stop - y[1]], groups)
        n, m = self.n[a.below], other.n[b.below]
        able = np.minimum(left, folded(b.most, groups)).sum(axis=1, dtype=np.int64) + np.minimum(self.over[a.below], b.over) >= needed(n, b.n[0], self.least)
        for i in np.flatnonzero(able):
            j = np.flatnonzero((other.component[b.below] != self.component[a.below][i]) & (np.minimum(m, n[i]) >= needed(m, n[i], self.least)))
            if a is b:
                j = j[j > i]
            if len(j):
                shared = np.minimum(right[j], left[i]).sum(axis=1, dtype=np.int64) + np.minimum(other.over[b.below][j], self.over[a.below][i])
                j = j[shared >= needed(m[j], n[i], self.least)]
                if self.forest and len(j):
                    own = self.group[a.below][i]
                    groups_of, one = np.unique(other.group[b.below][j], return_index=True)
                    j = j[one[groups_of != own]]
                    for group in (self.group, other.group):
                        group[np.isin(group, groups_of)] = own
                u, v = np.full(len(j), self.rep[a.below][i]), other.rep[b.below][j]
                found.append((np.maximum(u, v), np.minimum(u, v)))


def tree_join(least: Fraction, forest: bool):
    """Rows (head, one, two, side, rep, component, n, point) in order of a cell (head, one, two) -> pairs (u, v).

    A cell has the rows of one slice of a gathering, or those of two, told apart by side, which are joined to each other.
    """

    def cell(one: bool, side: np.ndarray, rep: np.ndarray, component: np.ndarray, n: np.ndarray, points: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        trees = [Tree(rep[at], component[at], n[at], [counts_of(points[i]) for i in at], least) for at in (np.flatnonzero(side == s) for s in (0, 1)) if len(at)]
        return trees[0].pairs(*trees[1:], forest=forest) if one or len(trees) == 2 else (rep[:0], rep[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for batch in chain(batches, (None,)):
            rows = [np.zeros(0, np.int64)] * 7 + [[]] if batch is None else [batch.column(c).to_numpy() for c in range(7)] + [batch.column(7).to_pylist()]
            rows = [np.concatenate([h[c] for h in held] + [rows[c]]) for c in range(7)] + [[p for h in (*held, rows) for p in h[7]]]
            if not len(rows[0]):
                continue
            edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in rows[:3]], axis=0)) + 1
            cuts = [0, *edges.tolist(), *([len(rows[0])] if batch is None else [])]  # the last cell may go on
            for a, b in zip(cuts, cuts[1:]):
                u, v = cell(rows[1][a] == rows[2][a], *(x[a:b] for x in rows[3:]))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
            held = [[x[cuts[-1] :] for x in rows]] if cuts[-1] < len(rows[0]) else []

    return run


def may_link(pairs: DataFrame, reps: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (u, v) whose points allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in (2, 3))
            good = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                a, b = counts_of(a), counts_of(b)
                over, groups = min(n[i] - int(a.sum()), m[i] - int(b.sum())), min(len(a), len(b))
                good[i] = int(np.minimum(folded(a, groups), folded(b, groups)).sum()) + over >= needed(int(n[i]), int(m[i]), least)
            yield batch.select([0, 1]).filter(pa.array(good))

    side = lambda c, n, p: reps.select(F.col("rep").alias(c), F.col("n").alias(n), F.col("point").alias(p))
    return pairs.join(side("u", "n", "a"), "u").join(side("v", "m", "b"), "v").select("u", "v", "n", "m", "a", "b").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, keyed: DataFrame, words: int, least: Fraction, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (u, v) of row_at whose exact sets have the similarity, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py()) for x in batch.column(1)], pa.list_(pa.int64()))], names=["rep", "own"])

    # nodes are written first, so that their size is known: where they are few, the texts needn't be dealt
    nodes = scratch.write(pairs.select(F.col("u").alias("row_at")).unionAll(pairs.select("v")).distinct(), f"{name}-nodes")
    sets = scratch.write(keyed.select("row_at", "text").join(nodes, "row_at", "left_semi").mapInArrow(run, "rep long, own array<long>"), f"{name}-sets")
    release(keyed.sparkSession)  # the texts' shuffle files, before the sets take their place
    both = pairs.join(sets.select(F.col("rep").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("rep").alias("v"), F.col("own").alias("b")), "v")
    share, sizes = F.size(F.array_intersect("a", "b")).cast("long"), (F.size("a") + F.size("b")).cast("long")
    out = scratch.write(both.where(share * (least.numerator + least.denominator) >= sizes * least.numerator).select("u", "v"), name)
    scratch.drop(f"{name}-nodes", f"{name}-sets")
    release(keyed.sparkSession)
    return out


def gathered(met: DataFrame, joined: DataFrame, reps: DataFrame) -> DataFrame:
    """Lists of two components or more -> the cells (head, one, two) that the trees are built on, with points.

    Lists with the same head, the set whose rep has the least hash, are one gathering: lists of much the same sets
    mostly share it, so that their pairs are looked at once. A gathering beyond SLICE rows is dealt in slices, each
    pair of which is a cell of its own.
    """
    rows = met.select("token", "rep", "n").join(joined, met.rep == joined.node, "left").select("token", "rep", "n", F.coalesce("component", "rep").alias("component"))
    heads = rows.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min(F.struct(F.xxhash64("rep"), "rep")).alias("head")).where("a < b").select("token", "head.rep").toDF("token", "head")
    own = rows.join(heads, "token").select("head", "rep", "n", "component").distinct()
    sizes = own.groupBy("head").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    part = F.pmod(F.xxhash64(F.lit(2), "rep"), F.col("slices"))
    cells = own.join(sizes, "head").withColumn("own", part).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    cells = cells.select("head", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"), (F.col("own") > F.col("with")).cast("int").alias("side"), "rep", "component", "n")
    placed = cells.join(reps.select("rep", "point"), "rep").select("head", "one", "two", "side", "rep", "component", "n", "point")
    return placed.repartition("head", "one", "two").sortWithinPartitions("head", "one", "two")


def similar_components(keyed: DataFrame, words: int, least: Fraction, scratch: Scratch, fingerprint=None, candidates=None) -> tuple[DataFrame, DataFrame]:
    """keyed (row_at unique, text) -> tables (row_at, key, n) of all texts and (key, n, rep, component) of all sets with shingles.

    rep is the least row_at of a set, component the least rep reachable over links of ``least`` or more.

    Three rounds, as pairs within a component can't change it. One compares each set of a list with the list's
    first, a pair a row; ``candidates``, given (rep, fp), may name more pairs (u, v). The next joins the lists that
    still hold two components by their trees, and of the pairs that may link verifies a forest. The last verifies all
    that may link and are still apart. So large groups of copies cost rows in proportion and no link is missed.
    """
    spark = keyed.sparkSession
    longs = lambda *names: ", ".join(f"{x} long" for x in names)
    seen = scratch.write(set_keys(keyed, words, fingerprint), "seen")
    keys = seen.where("token is null")
    often = seen.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(HOT).toPandas().sort_values("token")
    hot = often["token"].to_numpy(np.int64), often["times"].to_numpy(np.int64)
    reps = scratch.write(keys.where("n > 0").groupBy("key", "n").agg(F.min("row_at").alias("rep"), F.first("fp").alias("fp"), F.first("point").alias("point")), "reps")
    keys = scratch.write(keys.select("row_at", "key", "n"), "keys")
    scratch.drop("seen")
    sent = prefix_rows(keyed, words, least, hot).select("token", "salt", "n", "key", "pos")
    found = sent.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "key").mapInArrow(lists, longs("token", "salt", "n", "key", "pos", "first_n", "first_key", "first_pos"))
    found = scratch.write(found, "found")
    release(spark)
    name = reps.select("key", "n", "rep")
    first = name.select(F.col("key").alias("first_key"), F.col("n").alias("first_n"), F.col("rep").alias("first"))
    met = scratch.write(found.join(name, ["key", "n"]).join(first, ["first_key", "first_n"]).select("token", "rep", "n", "pos", "first", "first_n", "first_pos"), "met")
    scratch.drop("found")
    may = F.least(F.col("n") - F.col("pos"), F.col("first_n") - F.col("first_pos")) * (least.numerator + least.denominator) >= (F.col("n") + F.col("first_n")) * least.numerator
    pairs = met.where("rep <> first").where(may).select(F.greatest("rep", "first").alias("u"), F.least("rep", "first").alias("v"))
    if candidates:
        pairs = pairs.unionAll(candidates(reps.select("rep", "fp"), scratch))
    pairs = scratch.write(pairs.distinct(), "pairs")
    near = scratch.write(may_link(pairs, reps, least), "near")
    release(spark)
    links = verified(near, keyed, words, least, scratch, "links")
    joined = scratch.write(connected_components(links, scratch), "joined")
    for name, forest in (("forest", True), ("rest", False)):
        some = gathered(met, joined, reps).mapInArrow(tree_join(least, forest), longs("u", "v")).distinct()
        some = scratch.write(some.join(pairs, ["u", "v"], "left_anti"), f"{name}-pairs")
        release(spark)
        pairs, links = pairs.unionAll(some), links.unionAll(verified(some, keyed, words, least, scratch, name))
        joined = scratch.write(connected_components(links, scratch), f"{name}-joined")
    scratch.drop("met", "near")
    found = joined
    named = scratch.write(reps.join(found, reps.rep == found.node, "left").select("key", "n", "rep", F.coalesce("component", "rep").alias("component")), "named")
    return keys, named


def near_documents(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable over links, itself included.

    Two rows link where the similarity of their sets of shingles, whole texts lower-cased in A-Z, is ``least``
    or more. Texts without words (null, empty, blank) have an empty set and link nothing. Equal sets are one
    node, so a group of copies costs no pairs. Rows of one doc_id are told apart by (doc_id, text). Rows with
    a null doc_id have their size, a null component, and link nothing. Other columns are ignored, so none can
    clash. An empty table gives an empty table.
    """
    scratch, order = Scratch(docs.sparkSession, "jaccard"), free(docs, "order_at")
    every = ordered(docs.select("doc_id", "text"), scratch, order).select("doc_id", F.col(order).alias("row_at"), "text")
    known, unknown = every.where("doc_id is not null"), every.where("doc_id is null")
    keys, named = similar_components(known.select("row_at", "text"), words, Fraction(least).limit_denominator(10_000), scratch)
    placed = keys.join(named.select("key", "n", "component"), ["key", "n"], "left").select("row_at", "n", F.coalesce("component", "row_at").alias("component"))
    ids = known.select("row_at", "doc_id")
    out = placed.join(ids, "row_at").join(ids.select(F.col("row_at").alias("component"), F.col("doc_id").alias("component_id")), "component")
    nameless = set_keys(unknown.select("row_at", "text"), words).where("token is null").select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.select(F.col("doc_id").cast("long"), F.col("n").alias("n_shingles"), F.col("component_id").cast("long")).unionAll(nameless)
