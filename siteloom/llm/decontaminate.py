"""Benchmark leaks: rare shared shingles, SimHash of item-sized windows, Hamming blocks, exact verification.

A text at a similarity of ``least`` or more to an item shares that part of the item's shingles by weight.
So of each item only the rarest shingles that weigh over 1 - ``least`` of it are listed: a window without
one of them can't be a leak. Every window of the item's own number of words that holds one, at every start
and within its text, gets a 64-bit SimHash of its word shingles. An index over the items' own fingerprints
cuts the 64 bits into four blocks: a fingerprint within ``radius`` bits of an item's agrees with it in some
block but for radius // 4 bits, so every such block value is listed and no such window is missed. As no
radius holds for every text at ``least``, texts that share a listed shingle are compared exactly even
beyond it: shared shingles with their repeats, each weighted by its length in bytes, at each alignment.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch, free, ordered
from siteloom.llm.simhash import LOWER

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 15, 4
#: Words of text in one slice.
SLICE = 40000
#: Rows whose words are held at a time.
ROWS = 300
#: Items, and bytes of items, that one index may hold; larger benchmarks are searched in blocks of items.
INDEX_ITEMS, INDEX_BYTES = 4096, 8 << 20
CACHE_WORDS = 200_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+").findall
# Odd multipliers of the places in a shingle.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_hashes = _Hashes()


def forget() -> None:
    _hashes.clear()


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters; A-Z lower-cased."""
    return _WORD((text or "").encode().translate(LOWER))


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One mixed hash for every k consecutive words."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out += hashes[i : i + n] * _PLACES[i]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _window_prints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the run of ``size`` shingles at each start: a bit is set if it is in over half of them."""
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(bits) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(2 * (sums[starts + size] - sums[starts]) > size, axis=1).view(">u8").ravel().astype(np.uint64)


class Index:
    """Items by number of words, with the block tables of their fingerprints, and by their listed shingles."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, radius: int, least: float = SIMILARITY):
        self.radius, width = radius, 64 // BLOCKS
        reach = radius // BLOCKS
        masks = np.array([sum(1 << b for b in c) for r in range(reach + 1) for c in combinations(range(width), r)], dtype=np.uint64)
        self.items = []
        groups = defaultdict(list)
        for item_id, text in items:
            found = words(text)
            if not found:
                continue
            k = min(shingle, len(found))
            own = shingle_hashes(word_hashes(found), k)
            bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            mark = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(own)).view(">u8")[0]
            groups[k, len(found)].append((len(self.items), int(mark)))
            self.items.append((item_id, len(found), k, _bag(own, found, k)))
        self.sizes = {}
        for key, own in groups.items():
            ids, marks = np.array([i for i, _ in own]), np.array([m for _, m in own], dtype=np.uint64)
            tables = []
            for b in range(BLOCKS):
                part = (marks >> np.uint64(b * width)) & np.uint64((1 << width) - 1)
                values = (part[:, None] ^ masks[None, :]).ravel().astype(np.int64)
                owner = np.repeat(np.arange(len(own)), len(masks))
                ends = np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << width)))).astype(np.int32)
                tables.append((ends[1:] > ends[:-1], ends, owner[np.argsort(values, kind="stable")]))
            self.sizes[key] = (ids, marks, tables)
        self.marks = {i: m for own in groups.values() for i, m in own}
        self.listed = self._listed(least)

    def _listed(self, least: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """k -> (shingles, ascending; where the items of each begin; those items)."""
        held = Counter((k, h) for _, _, k, bag in self.items for h in bag)
        owners: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, _, k, bag) in enumerate(self.items):
            weight = {h: n * size for h, (n, size) in bag.items()}
            rest = sum(weight.values())
            enough = least * rest * (1 - 1e-9)
            for h in sorted(bag, key=lambda h: (held[k, h], -weight[h], h)):
                if rest < enough:
                    break
                owners[k].append((h, i))
                rest -= weight[h]
        out = {}
        for k, own in owners.items():
            own.sort()
            keys, at = np.unique(np.array([h for h, _ in own], dtype=np.uint64), return_index=True)
            out[k] = keys, np.append(at, len(own)), np.array([i for _, i in own])
        return out

    def near(self, key: tuple[int, int], prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius; a pair may come more than once."""
        ids, marks, tables = self.sizes[key]
        parts = prints.astype("<u8").view("<u2").reshape(-1, BLOCKS)
        out = []
        for b, (listed, ends, owner) in enumerate(tables):
            part = np.ascontiguousarray(parts[:, b])
            hit = np.flatnonzero(listed[part])
            value = part[hit].astype(np.int64)
            lo = ends[value]
            n = ends[value + 1] - lo
            window = np.repeat(hit, n)
            which = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            apart = np.bitwise_count(prints[window] ^ marks[which])
            good = apart <= self.radius
            out.append((window[good], ids[which[good]], apart[good]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _bag(shingles: np.ndarray, found: list[bytes], k: int) -> dict[int, tuple[int, int]]:
    """shingle -> (times, bytes)."""
    out: dict[int, tuple[int, int]] = {}
    for i, h in enumerate(shingles.tolist()):
        out[h] = (out[h][0] + 1 if h in out else 1, sum(map(len, found[i : i + k])))
    return out


def similarity(a: dict[int, tuple[int, int]], b: dict[int, tuple[int, int]]) -> float:
    """Sum of the lesser over sum of the greater shingle counts, by bytes."""
    both = sum(min(n, b[h][0]) * size for h, (n, size) in a.items() if h in b)
    return both / (sum(n * size for n, size in a.values()) + sum(n * size for n, size in b.values()) - both)


def _verify(index: Index, item: int, found: list[bytes], hashes: np.ndarray, starts: list[int], slack: int, least: float) -> tuple[float, int, int] | None:
    """Best (similarity, start, words) of the item over alignments within ``slack`` words of the windows."""
    _, n, k, bag = index.items[item]
    keys, best, done = np.fromiter(bag, np.uint64, len(bag)), None, -1
    last = max(0, len(found) - n)
    for at in sorted(set(starts)):
        lo, hi = max(done + 1, at - slack, 0), min(at + slack, last)
        if lo > hi:
            continue
        done = hi
        own = shingle_hashes(hashes[lo : hi + n], k)
        ahead = np.concatenate(([0], np.cumsum(np.isin(own, keys))))
        for s in range(lo, hi + 1):
            end = min(len(found), s + n)
            if end - s < k or ahead[end - k + 1 - lo] == ahead[s - lo]:
                continue  # it shares no shingle with the item
            value = similarity(_bag(own[s - lo : end - k + 1 - lo], found[s:end], k), bag)
            if value >= least and (best is None or value > best[0]):
                best = (value, s, end - s)
    return best


def search(index: Index, texts: list[str | None], least: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(text, item id, similarity, start word, words, least Hamming distance), one for each text and item."""
    at, size, slices, start = 0, 0, [], 0
    found = [words(t) for t in texts]
    for i, f in enumerate(found):
        size += len(f)
        if size > SLICE:
            slices.append((start, i + 1))
            start, size = i + 1, 0
    slices.append((start, len(found)))
    for a, b in slices:
        lengths = np.array([len(f) for f in found[a:b]], dtype=np.int64)
        if not lengths.sum():
            continue
        ends = np.cumsum(lengths)
        flat = word_hashes([w for f in found[a:b] for w in f])
        shared: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, (keys, begins, owner) in index.listed.items():
            own = shingle_hashes(flat, k)
            place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == own)
            text = np.searchsorted(ends, hit, side="right")
            inside = hit + k <= ends[text]
            for p, t, x in zip(hit[inside].tolist(), text[inside].tolist(), place[hit[inside]].tolist()):
                for i in owner[begins[x] : begins[x + 1]].tolist():
                    shared[t, i].append(p - int(ends[t] - lengths[t]))
        yield from ((a + t, *row) for t, row in _judged(index, shared, found[a:b], flat, ends - lengths, least))


def _judged(index: Index, shared: dict[tuple[int, int], list[int]], found: list[list[bytes]], flat: np.ndarray, begins: np.ndarray, least: float) -> Iterator[tuple[int, tuple[int, float, int, int, int]]]:
    """Leaks among the (text, item) pairs that share listed shingles at the given places.

    Windows of each item's size about those places are fingerprinted and looked up in the block tables. What
    comes within the radius is a candidate, and verified; then so is the rest, as a similarity of ``least``
    bounds no distance.
    """
    windows: dict[tuple[int, tuple[int, int]], dict[int, np.ndarray]] = defaultdict(dict)
    for (t, i), places in shared.items():
        _, n, k, _ = index.items[i]
        n_now = min(n, len(found[t]))
        spread = (np.array(places)[:, None] + np.arange(-(n_now - k), 1)).ravel()
        windows[t, (k, n)][i] = np.unique(np.clip(spread, 0, len(found[t]) - n_now))
    hashed: dict[tuple[int, int], np.ndarray] = {}
    for (t, key), own in sorted(windows.items()):
        k, n = key
        hashes = flat[begins[t] : begins[t] + len(found[t])]
        if (t, k) not in hashed:
            hashed[t, k] = shingle_hashes(hashes, k)
        starts = np.unique(np.concatenate(list(own.values())))
        prints = _window_prints(hashed[t, k], starts, min(n, len(found[t])) - k + 1)
        window, item, apart = index.near(key, prints)
        for i, at in sorted(own.items()):
            mine = item == i
            near = np.intersect1d(starts[window[mine]], at)
            options = [_verify(index, i, found[t], hashes, some.tolist(), 0, least) for some in (near, np.setdiff1d(at, near)) if len(some)]
            best = min((o for o in options if o), key=lambda o: (-o[0], o[1]), default=None)
            if best:
                distance = apart[mine].min() if mine.any() else np.bitwise_count(prints[np.searchsorted(starts, at)] ^ np.uint64(index.marks[i])).min()
                yield t, (index.items[i][0], *best, int(distance))


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words, hamming: one row for each document row and item in it.

    benchmark: (item_id, text). Every window of an item's size is kept from a similarity of ``least`` on,
    with the best alignment; ``hamming`` is the least distance of such a window's SimHash to the item's.
    Null and empty texts, and items without words, have no leaks. Items of fewer words than a shingle
    have one shingle, all their words. Repeated items and rows are all reported; null ids stay null.
    Empty tables give an empty table. A benchmark beyond the bounds of one index is searched in blocks of
    items, each over all documents, so what is broadcast stays bounded.
    """
    items = benchmark.select("item_id", "text").where("text is not null")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // INDEX_ITEMS), -(-size // INDEX_BYTES))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about INDEX_ITEMS rows
        sent = docs.sparkSession.sparkContext.broadcast(([(r.item_id, r.text) for r in rows], shingle, radius, least))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(*sent.value)
            for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
                keys = batch.column(0)
                got = list(search(index, batch.column(1).to_pylist(), least)) if index.sizes else []
                columns = [keys.take(pa.array([g[0] for g in got], pa.int64())), *(pa.array([g[i] for g in got], kind) for i, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()), (5, pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "similarity", "start_word", "n_words", "hamming"])
            forget()  # an idle worker holds no memory that other stages need

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long, n_words long, hamming long")
        out = part if out is None else out.unionAll(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a leak, with all their columns, whatever their names.

    Rows are judged one by one, so repeated rows stay or go together; null and empty texts stay; an empty
    table, or an empty benchmark, leaves the table as it is.
    """
    scratch, order = Scratch(docs.sparkSession, "leaks"), free(docs, "order_at")
    keyed = ordered(docs, scratch, order)
    found = leaks(keyed.select(F.col(order).alias("doc_id"), "text"), benchmark, **options)
    found = scratch.write(found.select(F.col("doc_id").alias(order)).distinct(), "found")
    return keyed.join(found, order, "left_anti").select(*docs.columns)
