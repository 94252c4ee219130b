"""Removal of byte strings that occur earlier in the corpus, by prefix-free parsing.

Parsing. A rolling hash runs over every text; the position with the least hash among the places of a
window-sized string is its trigger. Texts are cut at triggers into phrases that overlap by window - 1
bytes, so each string of ``window`` bytes lies in exactly one phrase, which its own bytes decide: equal
strings lie at equal offsets from equal triggers.

Dictionary and parse. Equal phrases are one dictionary entry; the parse is the rows (document, place) of an
entry, in corpus order. An occurrence that isn't the entry's first in the parse repeats as a whole. Suffixes
of an entry's first occurrence can be equal, as far as ``window`` bytes, to suffixes of entries with the same
trigger only. So the dictionary's suffixes are dealt by trigger, and each task sorts its share: the suffix
array of the dictionary, to a depth of ``window`` bytes, by ranges of one key, without the suffixes that have
no company. Neighbours in it with a common prefix of that depth are a class; the parse's order within a class
says which member is first in the corpus, and all others repeat. What follows in the parse after such a
prefix can't change a class, so no suffix array of the parse is needed beyond its own order.

Long repeats thus cost a row a phrase, not a row a byte. Rows of one key are reduced to their first within
each slice of input before any shuffle. Triggers with very many rows are found on a sample of documents and
dealt in parts; where over CROWD entries share a trigger, each string is dealt on its own and named, like a
phrase, by 128 bits, so that no task gets them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch, free, ordered, parallelism, release

WINDOW = 100
TRIGGER = 24
#: Bytes parsed at a time; longer texts are cut with an overlap, which changes phrases but not results.
SLICE = 1 << 20
POSITION_BITS = 27
#: Entries of one trigger beyond which its strings are dealt one by one.
CROWD = 2_000
#: Rows of one trigger from which on it is dealt in PARTS, as counted on a document in SAMPLE; and how many triggers at most. They decide costs, never results.
HOT, PARTS, SAMPLE, MOST_HOT = 50_000, 256, 64, 20_000
#: Suffixes that are sorted together, but for those of one trigger, which are never apart.
SORTED = 200_000
_MASK = np.uint64((1 << POSITION_BITS) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, dtype=np.uint64)


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash modulo 2^64, mixed, of every ``width`` bytes, by doubling."""
    have, size, powers = _TABLE[data], 1, {}
    out, done = None, 0
    while True:
        if width & size:
            factor = np.uint64(pow(_BASE, size, 2**64))
            if out is None:
                out = have
            else:
                n = len(data) - done - size + 1
                out = out[:n] * factor + have[done : done + n]
            done += size
        if 2 * size > width:
            break
        factor = np.uint64(pow(_BASE, size, 2**64))
        have = have[:-size] * factor + have[size:]
        size *= 2
    out = out ^ (out >> np.uint64(32))
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    rest = width - size
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def _pieces(keys: list[int], texts: list[bytes], window: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Slices of about SLICE bytes: ((key, place in the slice, offset in its text) ..., bytes)."""
    held, parts, size = [], [], 0
    for key, text in zip(keys, texts):
        at = 0
        while len(text) - at >= window:
            part = text[at : at + SLICE]
            held.append((key, size, at))
            parts.append(part)
            size += len(part)
            at += max(1, len(part) - window + 1)
            if size >= SLICE:
                yield held, b"".join(parts)
                held, parts, size = [], [], 0
    if held:
        yield held, b"".join(parts)


def _first_rows(*columns: np.ndarray) -> np.ndarray:
    """Which rows are the first of their key: key columns first, the last two give the order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns[:-2]:
        sorted_c = c[order]
        new[1:] |= sorted_c[1:] != sorted_c[:-1]
    first = np.zeros(len(order), dtype=bool)
    first[order[new]] = True
    return first


def phrases(keys: list[int], texts: list[bytes], window: int, trigger: int) -> Iterator[dict[str, np.ndarray]]:
    """Columns trig, phrase, doc, pos, n (strings in the phrase), dup (an earlier one is in the same slice)."""
    import xxhash

    for held, blob in _pieces(keys, texts, window):
        data = np.frombuffer(blob, np.uint8)
        rolled = _rolling(data, trigger)
        place = _sliding_min((rolled & ~_MASK) | np.arange(len(rolled), dtype=np.uint64), window - trigger + 1)
        place = (place & _MASK).astype(np.int64)
        starts = np.array([h[1] for h in held])
        ends = np.append(starts[1:], len(blob))
        valid = np.zeros(len(place), dtype=bool)
        for a, b in zip(starts.tolist(), ends.tolist()):
            valid[a : b - window + 1] = True
        place[~valid] = -1
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        lo = np.concatenate(([0], cut))
        hi = np.concatenate((cut, [len(place)]))
        keep = place[lo] >= 0
        lo, hi = lo[keep], hi[keep]
        digest = xxhash.xxh3_64_digest
        names = np.frombuffer(b"".join([digest(blob[a:b]) for a, b in zip(lo.tolist(), (hi + window - 1).tolist())]), ">i8").astype(np.int64)
        owner = np.searchsorted(starts, lo, side="right") - 1
        doc = np.array([h[0] for h in held], dtype=np.int64)[owner]
        pos = lo - starts[owner] + np.array([h[2] for h in held], dtype=np.int64)[owner]
        trig = rolled[place[lo]].view(np.int64)
        yield {"trig": trig, "phrase": names, "doc": doc, "pos": pos, "n": hi - lo, "dup": ~_first_rows(trig, names, doc, pos)}


def pieces(runs: list[tuple[int, bytes, list[dict]]], window: int) -> Iterator[dict[str, list]]:
    """Columns g, p, doc, pos, n, piece for the given runs (doc, text, [{trig, pos, n, crowd}]).

    A run of a rare trigger is one row with its bytes; of a common one, a row for each string, with the
    string's hash as p, no bytes, and only the first of each kind in a batch of rows (n: 1; the others
    n: -1, dealt apart).
    """
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    names = ("g", "p", "doc", "pos", "n", "piece")
    out: dict[str, list] = {c: [] for c in names}
    first: dict[tuple[int, int], tuple[int, int]] = {}

    def put(*values) -> None:
        for c, v in zip(names, values):
            out[c].append(v)

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for doc, text, own in runs:
        for run in own:
            at, n, trig = run["pos"], run["n"], run["trig"]
            if run["crowd"] <= CROWD:
                put(trig, 0, doc, at, n, text[at : at + n + window - 1])
                continue
            for i in range(at, at + n):
                key = trig, signed(digest(text[i : i + window]))
                place = doc, i
                if key not in first:
                    first[key] = place
                    continue
                if place < first[key]:
                    first[key], place = place, first[key]
                put(signed(digest(b"%d %d" % place)), 0, *place, -1, None)
        if len(out["g"]) + len(first) > 50_000:
            for key, place in first.items():
                put(*key, *place, 1, None)
            yield out
            out = {c: [] for c in names}
            first = {}
    for key, place in first.items():
        put(*key, *place, 1, None)
    if out["g"]:
        yield out


def suffix_classes(blob: bytes, starts: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Which of the suffixes at ``starts`` share their first ``window`` bytes with one of an earlier (doc, at).

    Suffixes are sorted by these bytes, then by their place in the corpus, so members of a class are neighbours.
    """
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(blob, np.uint8), window)[starts]
    text = np.ascontiguousarray(rows).view(f"S{window}").ravel()
    order = np.lexsort((at, doc, text))
    out = np.zeros(len(starts), dtype=bool)
    out[order[1:]] = text[order[1:]] == text[order[:-1]]
    return out


class Repeats:
    """Rows of pieces() in order of (g, p, doc, pos) -> runs of strings that occurred before."""

    def __init__(self, window: int):
        self.window, self.last, self.held, self.size = window, None, [], 0

    def feed(self, g: np.ndarray, p: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray, piece: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        alone = ~np.asarray(piece.is_valid())
        if alone.any():  # strings on their own: all but the first of a name repeat; n < 0 is known to
            key = np.stack((g[alone], p[alone]), axis=1)
            same = np.zeros(len(key), dtype=bool)
            same[1:] = (key[1:] == key[:-1]).all(axis=1)
            same[0] = self.last is not None and bool((key[0] == self.last).all())
            known = n[alone] < 0
            same &= ~known
            self.last = key[-1]
            again = same | known
            yield doc[alone][again], pos[alone][again], np.ones(int(again.sum()), dtype=np.int64)
        rest = np.flatnonzero(~alone)
        if len(rest):
            cut = np.flatnonzero(g[rest][1:] != g[rest][:-1]) + 1
            for part in np.split(rest, cut):
                if self.held and g[part[0]] != self.held[-1][0] and self.size >= SORTED:
                    yield self.flush()
                own = piece.take(pa.array(part)).to_pylist()
                self.held.append((g[part[0]], doc[part], pos[part], n[part], own))
                self.size += int(n[part].sum())

    def flush(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of the pieces held so far; those of one trigger are held together."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc, pos, n = (np.concatenate([h[i] for h in self.held]) for i in (1, 2, 3))
        pieces = [x for h in self.held for x in h[4]]
        self.held, self.size = [], 0
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(n)), n)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        again = suffix_classes(b"".join(pieces), np.repeat(np.cumsum(sizes) - sizes, n) + turn, doc[owner], pos[owner] + turn, self.window)
        before = np.concatenate(([False], again[:-1] & (owner[1:] == owner[:-1])))
        after = np.concatenate((again[1:] & (owner[1:] == owner[:-1]), [False]))
        first, last = np.flatnonzero(again & ~before), np.flatnonzero(again & ~after)
        return doc[owner[first]], pos[owner[first]] + turn[first], last - first + 1


def spans(marks: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under marked strings ({pos, n}: n strings from pos on)."""
    out: list[list[int]] = []
    for a, n in sorted((m["pos"], m["n"]) for m in marks or ()):
        b = a + n + window - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def _with_runs(docs: DataFrame, order: str, runs: DataFrame, fields: str, name: str, how: str) -> DataFrame:
    """docs with the runs of each as a list in the column ``name``."""
    lists = runs.groupBy(F.col("doc").alias(order)).agg(F.collect_list(F.struct(*fields.split())).alias(name))
    return docs.join(lists, order, how)


def hot_triggers(parsed: DataFrame) -> list[int]:
    """Triggers that seem to have HOT rows or more, by the parsed rows of a document in SAMPLE."""
    counts = parsed.where("(at & 1) = 0").groupBy("trig").count().where(F.col("count") >= HOT // SAMPLE)
    return [r.trig for r in counts.orderBy(F.desc("count"), "trig").limit(MOST_HOT).collect()]


def mark_repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW, trigger: int = TRIGGER) -> DataFrame:
    """docs (row_at, text) -> (doc, pos, n): the n strings from byte pos on each also start earlier."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in phrases(batch.column(0).to_pylist(), _bytes(batch.column(1)), window, trigger):
                at = (columns["pos"] << 17) | (columns["n"] << 1) | columns["dup"]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (columns["trig"], columns["phrase"], columns["doc"], at)], names=["trig", "phrase", "doc", "at"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            for columns in pieces(list(zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2).to_pylist())), window):
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds)], names=list(columns))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Repeats(window)
        put = lambda found: pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2].astype(np.int32))], names=["doc", "pos", "n"])
        for batch in batches:
            yield from map(put, state.feed(*(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)), batch.column(5)))
        yield put(state.flush())

    kinds = "trig long, phrase long, doc long, at long"
    # at: pos, n and dup in one number
    hot = hot_triggers(docs.where(F.pmod(F.xxhash64("row_at"), F.lit(SAMPLE)) == 0).mapInArrow(parse, kinds))
    parsed = docs.mapInArrow(parse, kinds).withColumn("hot", F.col("trig").isin(hot) if hot else F.lit(False))
    # rows that are known to repeat need no company: they are dealt by their own place; those of hot triggers by part of the phrase
    dup = F.expr("(at & 1) = 1")
    deal = F.when(dup, F.xxhash64("doc", "at")).when(F.col("hot"), F.xxhash64("trig", F.pmod("phrase", F.lit(PARTS)))).otherwise(F.col("trig"))
    dealt = parsed.select(deal.alias("g"), F.when(dup, F.xxhash64("at", "doc")).otherwise(F.col("phrase")).alias("p"), "doc", "at", "trig", "hot")
    group = Window.partitionBy("g")
    ranked = dealt.withColumn("before", F.lag("p").over(group.orderBy("p", "doc", "at")))
    fresh = F.when(F.col("before") == F.col("p"), 0).otherwise(1)
    ranked = ranked.withColumn("entries", F.sum(fresh).over(group))
    again = F.coalesce(dup | (F.col("before") == F.col("p")), F.lit(False))
    crowd = F.when(F.col("hot"), F.lit(CROWD + 1)).otherwise(F.col("entries"))
    known = ranked.select("trig", "doc", F.expr("at >> 17").alias("pos"), F.expr("cast((at >> 1) & 65535 as int)").alias("n"), crowd.cast("long").alias("crowd"), again.alias("again"))
    entries = scratch.write(known.where("again or crowd > 1"), "entries")
    release(docs.sparkSession)
    unsure = entries.where("not again").select("doc", "trig", "pos", "n", "crowd")
    rows = _with_runs(docs, "row_at", unsure, "trig pos n crowd", "runs", "inner").select("row_at", "text", "runs").mapInArrow(cut, "g long, p long, doc long, pos long, n int, piece binary")
    more = rows.repartition(parallelism(docs.sparkSession), "g", "p").sortWithinPartitions("g", "p", "doc", "pos").mapInArrow(compare, "doc long, pos long, n int")
    more = scratch.write(more, "strings")
    release(docs.sparkSession)
    return entries.where("again").select("doc", "pos", "n").unionAll(more)


def remove_repeats(docs: DataFrame, apply: Callable, schema: str, columns: list[str], window: int = WINDOW, trigger: int = TRIGGER) -> DataFrame:
    """apply(record batch of ``columns``, list of span lists) -> record batch of ``schema``, for every document.

    A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a document of
    smaller doc_id, or earlier in the same one. Strings never cross documents and are judged on the
    input. Null texts are empty; texts shorter than the window keep all. Rows with equal or null
    doc_ids are ordered by (doc_id, text), nulls first. An empty table gives an empty table. Other
    columns, whatever their names, don't matter.
    """
    scratch, order, runs = Scratch(docs.sparkSession, "suffix"), free(docs, "order_at"), free(docs, "runs")
    keyed = ordered(docs.select(*columns), scratch, order)
    marks = mark_repeats(keyed.select(F.col(order).alias("row_at"), "text"), scratch, window, trigger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield apply(batch.select(columns), [spans(m, window) for m in batch.column(len(columns)).to_pylist()])

    return _with_runs(keyed, order, marks, "pos n", runs, "left").select(*columns, runs).mapInArrow(run, schema)


def _digest(batch: pa.RecordBatch, found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    texts = _bytes(batch.column(1))
    kept = []
    for text, own in zip(texts, found):
        rest = hashlib.sha256()
        at = 0
        for a, b in [*own, (len(text), len(text))]:
            rest.update(text[at:a])
            at = b
        kept.append(rest.hexdigest())
    columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(b - a for a, b in own) for own in found], pa.int64()), pa.array([len(own) for own in found], pa.int64()), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_digests(docs: DataFrame, window: int = WINDOW, trigger: int = TRIGGER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay), as remove_repeats() says."""
    return remove_repeats(docs, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["doc_id", "text"], window, trigger)


def _without(text: str | None, own: list[tuple[int, int]]) -> str | None:
    """The text without its spans; a character only partly in a span stays."""
    if not own:
        return text
    data, out, at = text.encode(), [], 0
    for a, b in own:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode()


def cleaned_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same rows and columns, whatever their names, with repeats cut out of text, and n_chars, if there, counted anew.

    Null texts stay null; rows are ordered as remove_repeats() says, so of equal rows the first keeps its
    text; an empty table gives an empty table.
    """
    names = docs.columns

    def cut(batch: pa.RecordBatch, found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        texts = [_without(t, own) for t, own in zip(batch.column("text").to_pylist(), found)]
        new = {"text": pa.array(texts, pa.string())}
        if "n_chars" in names:
            new["n_chars"] = pa.array([n if not own else len(t) for n, own, t in zip(batch.column("n_chars").to_pylist(), found, texts)], pa.int64())
        return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return remove_repeats(docs, cut, docs.schema, names, window)
