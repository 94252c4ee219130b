"""Hidden Markov language model: Baum-Welch over partitions, exact scaled forward scores.

Symbols. The ``TOP`` most frequent training tokens have emissions of their own in all rounds; all others are
tied to ``RARE`` hash classes until the last round, whose expected counts are gathered token by token and give
emissions of its own to every token that training texts hold ``OWN`` times or more. That table grows with the
corpus and is distributed: it is summed by token and joined to the tokens of each slab of texts. What is rarer
is emitted as its class and then chosen within it by its training count plus one. So the model gives every
token sequence a probability.

Recursion. Texts are cut into stretches of ``STRETCH`` tokens. The scaled product of a stretch's
transition and emission matrices is found for all stretches of a slice side by side; chaining the
products through a text gives its exact likelihood and, in training, the exact forward and backward
vectors at each stretch's edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch, release

STATES, ROUNDS = 4, 4
#: Training occurrences from which on a token has emissions of its own; classes of the others.
OWN, RARE = 8, 1024
#: Tokens that are free in all rounds; their table goes to all tasks.
TOP = 65_536
STRETCH = 128
#: Tokens in one slice of the recursion, and in one slab of texts.
SLICE, SLAB = 300_000, 3_000_000
PRIOR = 10.0
END = b""


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all tokens, their number by text): lower-cased (A-Z) words between ASCII white space, then the end, which no word equals."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # the library lower-cases some slices wrongly: it gets a copy
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("").cast(pa.large_string())))
    words = lists.flatten()
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at the edges leaves empty words
    upto = np.concatenate(([0], np.cumsum(real)))[offsets]
    counts = np.diff(upto) + 1
    place = np.full(int(counts.sum()), -1, dtype=np.int64)
    ends = np.cumsum(counts) - 1
    inside = np.ones(len(place), dtype=bool)
    inside[ends] = False
    place[inside] = np.flatnonzero(real)
    return words.take(pa.array(np.where(inside, place, 0), mask=~inside)).cast(pa.large_binary()).fill_null(END), counts


def held_out(doc_id: str = "doc_id", parts: int = 7, part: int = 2):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def most_frequent(words: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of greatest c, ties by word.

    A histogram over steps of c (a few hundred rows) first tells which steps hold them, so that tasks
    send hardly more than ``top`` rows together, not ``top`` rows each.
    """
    stepped = words.withColumn("step", F.floor(F.log2("c") * 16))
    enough, least = 0, 0
    for r in sorted(stepped.groupBy("step").count().collect(), reverse=True):
        if enough >= top:
            break
        enough, least = enough + r["count"], r["step"]
    return stepped.where(F.col("step") >= least).drop("step").orderBy(F.desc("c"), "word").limit(top)


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit)


def begin(unigram: np.ndarray, states: int, seed: int = 7) -> Model:
    """States that mostly stay, with emissions scattered about the unigram's."""
    emit = unigram[:, None] * np.exp(np.random.Generator(np.random.PCG64(seed)).normal(size=(len(unigram), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class _Slice:
    """Stretches of some texts, longest first, and their matrix products."""

    def __init__(self, model: Model, texts: list[np.ndarray]):
        self.model = model
        lengths = np.array([len(t) for t in texts])
        counts = -(-lengths // STRETCH)
        self.flat = np.concatenate(texts)
        text_at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        text = np.repeat(np.arange(len(texts)), counts)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        size = np.minimum(STRETCH, lengths[text] - turn * STRETCH)
        order = np.argsort(-size, kind="stable")
        self.at, self.size = (text_at[text] + turn * STRETCH)[order], size[order]
        self.first = (turn == 0)[order]
        self.row = np.empty(len(order), dtype=np.int64)
        self.row[order] = np.arange(len(order))
        self.counts, self.stretch_at = counts, np.cumsum(counts) - counts
        # how many stretches are longer than t
        self.live = np.searchsorted(-self.size, -np.arange(STRETCH), side="left")
        k = len(model.start)
        step = np.where(self.first[:, None, None], model.start[None, None, :], model.move[None])
        product = step * model.emit[self.flat[self.at]][:, None, :]
        logs = np.zeros(len(product))
        for t in range(1, STRETCH):
            n = self.live[t]
            if not n:
                break
            now = (product[:n].reshape(-1, k) @ model.move).reshape(n, k, k)
            now *= model.emit[self.flat[self.at[:n] + t]][:, None, :]
            if t % 8 == 0:
                top = now.max(axis=(1, 2))
                now /= top[:, None, None]
                logs[:n] += np.log(top)
            product[:n] = now
        self.product, self.logs = product, logs

    def chain(self) -> tuple[np.ndarray, np.ndarray]:
        """Natural-log likelihood of each text; the scaled forward vector before each stretch."""
        k = len(self.model.start)
        v, total = np.full((len(self.counts), k), 1 / k), np.zeros(len(self.counts))
        before = np.empty((len(self.row), k))
        order = np.argsort(-self.counts, kind="stable")
        live = np.searchsorted(-self.counts[order], -np.arange(self.counts.max()), side="left")
        for j, n in enumerate(live):
            own = order[:n]
            rows = self.row[self.stretch_at[own] + j]
            before[rows] = v[own]
            after = np.einsum("nk,nkl->nl", v[own], self.product[rows])
            scale = after.sum(axis=1)
            v[own] = after / scale[:, None]
            total[own] += np.log(scale) + self.logs[rows]
        return total, before

    def behind(self) -> np.ndarray:
        """The scaled backward vector after each stretch."""
        k = len(self.model.start)
        w = np.ones((len(self.counts), k))
        after = np.empty((len(self.row), k))
        for j in range(self.counts.max() - 1, -1, -1):
            own = np.flatnonzero(self.counts > j)
            rows = self.row[self.stretch_at[own] + j]
            after[rows] = w[own]
            now = np.einsum("nkl,nl->nk", self.product[rows], w[own])
            w[own] = now / now.sum(axis=1, keepdims=True)
        return after

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts: starts, moves, and of each flat token the state it was emitted from."""
        m, (_, before) = self.model, self.chain()
        k, longest = len(m.start), int(self.size.max())
        forward = np.zeros((longest, len(self.at), k))
        for t in range(longest):
            n = self.live[t]
            own = before[:n] @ m.move if t == 0 else forward[t - 1, :n] @ m.move
            if t == 0:
                own[self.first[:n]] = m.start
            own *= m.emit[self.flat[self.at[:n] + t]]
            forward[t, :n] = own / own.sum(axis=1, keepdims=True)
        beta = self.behind()
        starts, moves, states = np.zeros(k), np.zeros((k, k)), np.empty((len(self.flat), k))
        for t in range(longest - 1, -1, -1):
            n = self.live[t]
            at = self.at[:n] + t
            gamma = forward[t, :n] * beta[:n]
            gamma /= gamma.sum(axis=1, keepdims=True)
            states[at] = gamma
            reach = m.emit[self.flat[at]] * beta[:n]
            back = reach @ m.move.T
            came = forward[t - 1, :n] if t else before[:n]
            share = came / (came * back).sum(axis=1, keepdims=True)
            if t == 0:
                starts += gamma[self.first[:n]].sum(axis=0)
                share = share * ~self.first[:n, None]
            moves += m.move * (share.T @ reach)
            beta[:n] = back / back.sum(axis=1, keepdims=True)
        return starts, moves, self.flat, states


def _slices(texts: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol sequence."""
    parts = [_Slice(model, texts[a:b]).chain()[0] for a, b in _slices(texts)]
    return np.concatenate(parts) / np.log(10) if parts else np.zeros(0)


# -- slabs: some texts with a list of their tokens ----------------------------------------------------

_SLAB = "slab long, doc_id array<long>, held array<boolean>, sizes array<int>, codes binary, words array<binary>, times array<int>"
_CODED = "slab long, doc_id array<long>, held array<boolean>, sizes array<int>, symbols binary, middle array<binary>, kinds binary, known array<long>, base array<double>, choice array<double>"


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd"), "<i4")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in their order, dealt anew: as many at once as hold about SLAB tokens of six bytes, one at least, whatever Spark's batches are."""
    kept, total = [], 0
    for batch in batches:
        start = 0
        size = pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        while start < batch.num_rows:
            done = int(size[start - 1]) if start else 0
            stop = int(np.searchsorted(size, done + 6 * SLAB - total))
            stop = min(batch.num_rows, stop if kept else max(stop, start + 1))
            if stop > start:
                kept.append(batch.slice(start, stop - start))
                total += int(size[stop - 1]) - done
            start = stop
            if start < batch.num_rows:
                yield pa.concat_batches(kept)
                kept, total = [], 0
    if kept:
        yield pa.concat_batches(kept)


def slabs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) -> slabs of about SLAB tokens.

    codes are places in the slab's own list of tokens, times how often each is in its training texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for part in _gathered(batches):
            flat, counts = tokens(part.column(2))
            coded = flat.dictionary_encode()
            codes, held = coded.indices.to_numpy(), np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(bool), counts)
            times = np.bincount(codes[~held], minlength=len(coded.dictionary))
            yield _row(_SLAB, number, part.column(0), part.column(1), counts, _packed(codes), coded.dictionary.cast(pa.binary()), times)
            number += 1

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _SLAB)


_KINDS = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.int64(), "array<boolean>": pa.bool_(), "array<int>": pa.int32(), "array<binary>": pa.binary(), "array<double>": pa.float64()}


def _row(schema: str, *values) -> pa.RecordBatch:
    """One row: numbers and bytes as they are, arrays as lists."""
    names, columns = [], []
    for field, value in zip(schema.split(", "), values, strict=True):
        name, kind = field.split()
        if kind.startswith("array"):
            items = value if isinstance(value, pa.Array) else pa.array(value)
            items = items.take(pa.array(np.arange(len(items)))).cast(_KINDS[kind])
            column = pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
        else:
            column = pa.array([value], _KINDS[kind])
        names.append(name), columns.append(column)
    return pa.RecordBatch.from_arrays(columns, names=names)


def _array(table: pa.Table, name: str) -> np.ndarray:
    """The only row's list as an array."""
    return table.column(name)[0].values.to_numpy(zero_copy_only=False)


def counted(rows: DataFrame) -> DataFrame:
    """slabs -> (slab, at, c, word, alone): of each token of each slab its place and training count; word in one row a token.

    alone: the count is that of the slab's own training texts, as for all tokens that no other slab trains on.

    A token has one row a slab at most, so no token has many.
    """
    each = rows.select("slab", F.posexplode(F.arrays_zip("words", "times")).alias("at", "t")).select("slab", "at", F.col("t.words").alias("w"), F.col("t.times").alias("times"))
    same = Window.partitionBy("w")
    placed = each.select("slab", "at", "w", "times", F.sum("times").over(same).alias("c"), F.row_number().over(same.orderBy("slab")).alias("nth"))
    return placed.select("slab", "at", "c", F.when(F.col("nth") == 1, F.col("w")).alias("word"), (F.col("c") == F.col("times")).alias("alone"))


def settle(rows: DataFrame, counts: DataFrame, top: list[bytes], often: np.ndarray, mass: np.ndarray, scale: float, own: int) -> DataFrame:
    """Slabs with symbols in place of codes, and by document what depends on counts only.

    counts (slab, at, c): training counts of the tokens that are neither top, whose counts are ``often``, nor alone. Symbols: top tokens by rank, then classes, then the slab's other tokens of ``own`` or more
    occurrences, whose texts are the list ``middle`` and whose classes are ``kinds``. known: tokens seen in
    training; base: the base score; choice: log10 of the choices within classes; all by document.
    """
    rare, n_top = len(mass), len(top)
    sent = rows.sparkSession.sparkContext.broadcast((pa.array(top, pa.binary()), often))  # the top tokens

    def run(slab: pa.Table, found: pa.Table) -> pa.Table:
        tops, of_tops = sent.value
        rank = pc.index_in(slab.column("words")[0].values, tops).fill_null(-1).to_numpy().astype(np.int64)
        count = _array(slab, "times").astype(np.int64)
        count[found.column("at").to_numpy()] = found.column("c").to_numpy()
        count[rank >= 0] = of_tops[rank[rank >= 0]]
        middle, loose = np.flatnonzero((rank < 0) & (count >= own)), np.flatnonzero((rank < 0) & (count < own))
        strange = np.flatnonzero(rank < 0)
        kind = np.zeros(len(count), dtype=np.int64)
        kind[strange] = [crc32(w) % rare for w in slab.column("words")[0].values.take(pa.array(strange)).to_pylist()]
        symbol, choice = rank.copy(), np.zeros(len(count))
        symbol[middle] = n_top + rare + np.arange(len(middle))
        symbol[loose] = n_top + kind[loose]
        choice[loose] = np.log10((count[loose] + 1) / mass[kind[loose]])
        sizes = _array(slab, "sizes").astype(np.int64)
        codes = _unpacked(slab.column("codes")[0].as_py(), int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        by_doc = lambda x: np.add.reduceat(x[codes], begins)
        words = slab.column("words")[0].values.take(pa.array(middle))
        row = _row(
            _CODED, slab.column("slab")[0].as_py(), slab.column("doc_id")[0].values, slab.column("held")[0].values, sizes, _packed(symbol[codes]), words, _packed(kind[middle]),
            by_doc((count > 0).astype(np.int64)), by_doc(np.log10(count + 1.0)) - sizes * scale, by_doc(choice),
        )
        return pa.Table.from_batches([row])

    return rows.groupBy("slab").cogroup(counts.groupBy("slab")).applyInArrow(run, _CODED)


def _texts(sizes: np.ndarray, symbols: bytes) -> list[np.ndarray]:
    return np.split(_unpacked(symbols, int(sizes.sum())), np.cumsum(sizes)[:-1])


def gather(model: Model, coded: DataFrame, first: int, free: bool) -> DataFrame:
    """One Baum-Welch pass over the training texts under tied classes: (row, word, e0, e1, ...) of expected counts.

    The classes begin at symbol ``first``. row is a place among the fixed symbols, then the moves, then the
    start, with no word. If ``free``, tokens that have a symbol of their own in the slab are counted by word,
    with row -1, and not with their class. A task sends a row for each fixed symbol that it met, and a slab one
    for each other.
    """
    n, k = model.emit.shape
    sent = coded.sparkSession.sparkContext.broadcast(model)
    names = [f"e{j}" for j in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = sent.value
        emits, moves, starts = np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)
        put = lambda row, word, x: pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(word, pa.binary()), *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(k))], names=["row", "word", *names])
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = batch.column(2)[i].values.to_numpy().astype(np.int64)
                tied = np.concatenate((np.arange(n), first + _unpacked(batch.column(4)[i].as_py(), batch.column(5)[i].as_py())))
                texts = [t for t, out in zip(_texts(sizes, batch.column(3)[i].as_py()), batch.column(1)[i].as_py()) if not out]
                own = np.zeros((len(tied) if free else n, k))
                for a, b in _slices(texts):
                    s, mv, flat, states = _Slice(fixed, [tied[t] for t in texts[a:b]]).expected()
                    starts, moves = starts + s, moves + mv
                    symbols = np.concatenate(texts[a:b]) if free else flat
                    for j in range(k):
                        own[:, j] += np.bincount(symbols, states[:, j], minlength=len(own))
                emits += own[:n]
                met = np.flatnonzero(own[n:].sum(axis=1))
                if len(met):
                    yield put(np.full(len(met), -1), batch.column(6)[i].values.take(pa.array(met)), own[n:][met])
        rows = np.concatenate((emits, moves, starts[None]))
        keep = np.flatnonzero(rows.sum(axis=1))
        yield put(keep, [None] * len(keep), rows[keep])

    found = coded.select("slab", "held", "sizes", "symbols", "kinds", F.size("middle").alias("n"), *(["middle"] if free else []))
    sums = found.mapInArrow(run, "row long, word binary, " + ", ".join(f"{c} double" for c in names))
    return sums.groupBy("row", "word").agg(*(F.sum(c).alias(c) for c in names))


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, top: int = TOP, rare: int = RARE, own: int = OWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability).

    Trained on all documents but those whose crc32(doc_id as text) mod 7 is 2; null doc_ids train. Null
    and empty texts are one token, the end. Rows are scored one by one, so repeated rows get equal
    scores each. An empty table gives an empty table; without training rows every token is unknown.
    Other columns are not looked at. At least one round is made. base_score: sum over tokens of log10((c + 1) / (N + V + 1)).
    """
    spark = docs.sparkSession
    rounds = max(1, rounds)
    scratch, names = Scratch(spark, "hmm"), [f"e{j}" for j in range(states)]
    rows = scratch.write(slabs(docs.select("doc_id", "text").withColumn("held_out", held_out())), "slabs")
    counts = scratch.write(counted(rows), "counted")
    release(spark)
    words = scratch.write(counts.where("word is not null and c > 0").select("word", "c"), "words")
    n_tokens, n_words = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total = float(n_tokens + n_words + 1)

    first = most_frequent(words, top).toPandas()  # ``top`` rows
    first_words = [bytes(w) for w in first["word"]]
    last = first.iloc[-1] if len(first) else None
    others = words.where((F.col("c") < int(last["c"])) | ((F.col("c") == int(last["c"])) & (F.col("word") > F.lit(bytes(last["word"]))))) if len(first) else words
    weight, loose = F.col("c") + 1, F.col("c") < own
    every, rest = np.ones(rare), np.ones(rare)
    for r in others.groupBy((F.crc32("word") % rare).alias("kind")).agg(F.sum(weight).alias("every"), F.sum(F.when(loose, weight).otherwise(0)).alias("rest")).collect():  # at most ``rare`` rows
        every[r["kind"]] += r["every"]
        rest[r["kind"]] += r["rest"]
    known = (first["c"].to_numpy(np.float64) + 1) / total  # of the top tokens
    tied, free = (np.concatenate((known, x / total)) for x in (every, rest))

    apart = counts.where(~F.col("alone") & ((F.col("c") <= int(last["c"])) if len(first) else F.lit(True))).select("slab", "at", "c")
    coded = scratch.write(settle(rows, apart, first_words, first["c"].to_numpy(np.int64), rest, math.log10(total), own), "coded")
    scratch.drop("slabs", "counted")
    release(spark)

    k, n = states, len(first) + rare
    model = begin(tied / tied.sum(), states)
    for turn in range(rounds):
        last_turn = turn == rounds - 1
        gathered = scratch.write(gather(model, coded, len(first), last_turn), "gathered")
        release(spark)
        fixed = gathered.where("row >= 0").select("row", *names).toPandas()  # at most the fixed symbols, the moves and the start
        got = np.zeros((n + k + 1, k))
        got[fixed["row"].to_numpy(np.int64)] = fixed[names].to_numpy(np.float64)
        emit = got[:n] + PRIOR * (free if last_turn else tied)[:, None]
        norm = emit.sum(axis=0)
        if last_turn:
            met = gathered.where("row < 0").select("word", *(F.col(c).alias(f"n_{c}") for c in names))
            table = others.where(~loose).join(met, "word", "left").select("word", *((F.coalesce(f"n_{c}", F.lit(0.0)) + PRIOR * weight / total).alias(c) for c in names))
            table = scratch.write(table, "table")
            norm = norm + np.array([x or 0.0 for x in table.agg(*(F.sum(c) for c in names)).first()])
            table = table.select("word", *((F.col(c) / float(norm[j])).alias(c) for j, c in enumerate(names)))
        model = Model((got[-1] + 1) / (got[-1] + 1).sum(), (got[n : n + k] + 1) / (got[n : n + k] + 1).sum(axis=1, keepdims=True), emit / norm)
    scratch.drop("gathered", "words")
    release(spark)

    sent = spark.sparkContext.broadcast(model)

    def run(slab: pa.Table, found: pa.Table) -> pa.Table:
        fixed, sizes = sent.value, _array(slab, "sizes").astype(np.int64)
        extra = np.empty((slab.column("n_middle")[0].as_py(), states))
        for j, c in enumerate(names):
            extra[found.column("at").to_numpy(), j] = found.column(c).to_numpy()
        path = log_likelihoods(Model(fixed.start, fixed.move, np.concatenate((fixed.emit, extra))), _texts(sizes, slab.column("symbols")[0].as_py()))
        columns = [slab.column("doc_id")[0].values, slab.column("held")[0].values, pa.array(sizes), slab.column("known")[0].values, slab.column("base")[0].values, pa.array(path + _array(slab, "choice"))]
        return pa.Table.from_arrays([c.take(pa.array(np.arange(len(c)))) for c in columns], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    emissions = coded.select(F.col("slab").alias("own"), F.posexplode("middle").alias("at", "word")).join(table, "word").drop("word")
    left = coded.select("slab", "doc_id", "held", "sizes", "symbols", "known", "base", "choice", F.size("middle").alias("n_middle"))
    scored = left.groupBy("slab").cogroup(emissions.groupBy("own")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
