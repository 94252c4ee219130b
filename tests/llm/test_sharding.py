import random
import zlib
from collections import defaultdict
from itertools import combinations

from siteloom.llm import sharding as s


def brute_capacity(sizes, k):
    best = sum(sizes)
    for cuts in combinations(range(1, len(sizes)), min(k, len(sizes)) - 1):
        edges = [0, *cuts, len(sizes)]
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])))
    return best


def check(spark, rows, k):
    docs = spark.createDataFrame([(*x, "own") for x in rows], "doc_id long, text string, shard string").repartition(3)
    got = s.shard(docs, k).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    groups, shards, size = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        groups[r.text_crc32].add(r.shard)
        shards[r.shard].append((r.slot, r.doc_id is not None, r.doc_id or 0))
        size[r.shard] += r.size
        assert 0 <= r.shard < k and r.law == "bytes" and r.grown_shard is None
    assert all(len(g) == 1 for g in groups.values())
    for own in shards.values():
        own.sort()
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    order = sorted(by, key=lambda t: (all(d is not None for d in by[t]) or min((d for d in by[t] if d is not None), default=None) is not None, min((d for d in by[t] if d is not None), default=-1)))
    sizes = [(len(t.encode()) + 1) * len(by[t]) for t in order]
    assert max(size.values()) <= got[0].capacity == brute_capacity(sizes, k)


def test_smallest_capacity(spark):
    for seed in range(3):
        r = random.Random(seed)
        rows = [(i, r.choice("abcdefghijklmnop") * r.randrange(0, 60)) for i in range(30)]
        rows = [(i, t if seed < 2 else ("hot" * 30 if i % 2 else t)) for i, t in rows][: 14 + seed]
        check(spark, rows, 3)


def test_nulls_repeats_and_few(spark):
    check(spark, [(None, "a"), (1, None), (1, None), (2, ""), (3, "é" * 5000), (3, "é" * 5000), (4, "b")], 3)
    assert s.shard(spark.createDataFrame([], "doc_id long, text string"), 8).collect() == []
    check(spark, [(5, "x")], 8)
