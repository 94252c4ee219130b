import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from siteloom.llm import importance as m


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    low = {c: c + 32 for c in range(65, 91)}

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    own, want = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = Counter(x for _, f in own for x in f), Counter(x for _, f in want for x in f)
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    rows = []
    for (d, _), (words, f) in zip(docs, own):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=key)


def key(x):
    return tuple((v is not None, v) for v in x)


def got(spark, docs, target, **more):
    docs = spark.createDataFrame([(*x, 7, 8) for x in docs], "doc_id long, text string, weight int, n_words int").repartition(3)
    target = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "doc_id long, text string")
    return sorted(map(tuple, m.resample(docs, target, **more).collect()), key=key)


def texts(seed, n, words):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.choice((0, 3, 19, 20, 25, 60, 200)))) for _ in range(n)]


def test_against_brute_force(spark, monkeypatch):
    words = ["Alpha", "beta-gamma", "x1", "Ünï", "don't", "end.", "the", "of"] + ["w%d" % i for i in range(300)]
    docs, target = list(zip(range(0, 900, 3), texts(1, 300, words))), texts(2, 20, words[:60])
    want = brute(docs, target)
    assert got(spark, docs, target) == want and sum(r[4] is not None for r in want) > 10
    monkeypatch.setattr(m, "ROWS", 7)
    monkeypatch.setattr(m, "ENTRIES", 100)
    monkeypatch.setattr(m, "KNOWN", 5)
    assert got(spark, docs, target, longest=2, buckets=97, percent=33, seed=5) == brute(docs, target, 2, 97, 33, 20, 5)


def test_draw_prefers_the_target(spark):
    docs = list(zip(range(1000), [" ".join("law%d" % (i % 9) for i in range(30)) if d % 10 == 0 else " ".join("c%d" % ((d + i) % 500) for i in range(30)) for d in range(1000)]))
    rows = got(spark, docs, [docs[0][1]] * 500)
    drawn = [r[0] for r in rows if r[4] is not None]
    assert len(drawn) == 100 and sum(d % 10 == 0 for d in drawn) > 80


def test_nulls_ties_repeats_and_empty(spark):
    line = "one two three " * 7
    docs = [(1, line), (1, line), (1, line + "four"), (2, None), (3, ""), (None, line), (None, None), (4, "…"), (5, "a " * 50_000), (6, line)] + [(i, line) for i in range(10, 40)]
    assert got(spark, docs, [line, None]) == brute(docs, [line, None])
    assert got(spark, docs, []) == brute(docs, [])
    assert got(spark, [], [line]) == []


def test_blocks_are_csr(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "b")], "doc_id long, text string").coalesce(1)
    (b,) = m.count_blocks(docs, "doc_id", 1, 10_000).collect()
    bucket = {w: zlib.crc32(w.encode()) % 10_000 for w in "ab"}
    assert b.doc_id == [1, 2, 3] and b.starts == [0, 2, 2, 3] and b.n_features == [3, 0, 1]
    assert dict(zip(b.bucket[:2], b.times[:2])) == {bucket["a"]: 2, bucket["b"]: 1} and b.bucket[2] == bucket["b"]
    total = m.column_sums(m.count_blocks(docs, "doc_id", 1, 10_000), 10_000)
    assert total[bucket["a"]] == 2 == total[bucket["b"]] and int(np.sum(total)) == 4


def test_counts_are_kept_by_document(spark):
    """A reader holds thousands of rows at once, so a row must not be a block of thousands of documents."""
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (None, None), (3, "b")], "doc_id long, text string").coalesce(1)
    rows = m.count_rows(docs, "doc_id", 1, 10_000).collect()
    bucket = {w: zlib.crc32(w.encode()) % 10_000 for w in "ab"}
    assert [(r.doc_id, r.n_features, dict(zip(r.bucket, r.times))) for r in rows] == [(1, 3, {bucket["a"]: 2, bucket["b"]: 1}), (2, 0, {}), (None, 0, {}), (3, 1, {bucket["b"]: 1})]
    blocks, kept = (m.column_sums(f(docs, "doc_id", 1, 10_000), 10_000) for f in (m.count_blocks, m.count_rows))
    assert (blocks == kept).all()
