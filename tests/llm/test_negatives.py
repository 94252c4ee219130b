import math
import random

import pytest

from siteloom.llm import negatives as n


def brute(rows, every=100, positives=5, negatives=5, lowest=80, highest=100, scale=256):
    own = []
    for at, (i, e, label) in enumerate(rows):
        if i is None or e is None or label is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * scale) for x in e):
            continue
        own.append((at, i, label, [math.floor(scale * x) for x in e]))
    score = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a[3], b[3]))))
    out = []
    for a in own:
        if a[1] % every:
            continue
        near = sorted(((-score(a, b), b[1]) for b in own if b[0] != a[0] and b[2] == a[2]))[:positives]
        for s, p in near:
            s = -s
            far = sorted((-score(a, b), b[1]) for b in own if b[2] != a[2] and lowest * s <= 100 * score(a, b) <= highest * s)[:negatives]
            out += [(a[1], p, rank, i, s, -t) for rank, (t, i) in enumerate(far, 1)]
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*x, 9, 1.5) for x in rows], "vec_id long, embedding array<double>, label int, row_at int, score double").repartition(3)
    return sorted(map(tuple, n.hard_negatives(df, **more).collect()))


def vectors(seed, count, size=6, spread=1.0, labels=3):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 1) * math.exp(r.gauss(0, spread)) for _ in range(size)], r.randrange(labels)) for i in range(count)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 17)
    monkeypatch.setattr(n, "GROUP", 5)
    rows = vectors(1, 700)
    want = brute(rows, every=20)
    assert got(spark, rows, every=20) == want and len(want) > 300


def test_lengths_prune_blocks(spark):
    """Scores in blocks that can't reach the k-th best are never found out."""
    search = n.Search(2, False)
    seen = []
    real = search.scores
    search.scores = lambda a, v, top: seen.append(top) or real(a, v, top)
    search.add({"row_at": [0], "vec_id": [0], "label": 1, "top": 1.0, "vector": [1.0, 0.0]})
    search.start()
    import numpy as np

    for k, x in enumerate((9.0, 8.0, 3.0, 1.0)):
        search.feed({"label": 1, "top": x, "row_at": np.array([2 * k + 1, 2 * k + 2]), "vec_id": np.array([2 * k + 1, 2 * k + 2]), "size": np.array([2, 2]), "vector": np.array([x, 0.0, x, 0.0])})
    assert seen == [9.0] and search.found().column("vec_id").to_pylist() == [1, 2]


def test_hot_label_ties_repeats_and_bounds(spark):
    rows = [(i, [1.0, float(i % 4)], 0 if i % 3 else 1) for i in range(90)] + [(100, [1.0, 2.0], 0), (100, [1.0, 2.0], 0), (200, [0.0, 0.0], 0), (300, [-1.0, -1.0], 1)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, every=10, positives=2, negatives=3, lowest=95, highest=99) == brute(rows, 10, 2, 3, 95, 99)


def test_nulls_and_odd_components(spark):
    odd = [(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (2, [1.0, 1.9], 2), (None, [1.0, 2.0], 2), (4, None, 2), (5, [1.0, 2.0], None), (6, [1.0, None], 2), (7, [1.0, float("nan")], 2), (8, [float("inf"), 1.0], 2), (9, [1.7e308, 1.0], 2), (10, [1.0], 2), (11, [], 2), (12, [1.0, 2.0, 3.0], 1), (13, [1e9, 1e9], 1), (14, [1e300, -1e300], 2), (15, [3e8, 3e8], 2)]
    assert got(spark, odd) == brute(odd) != []
    assert got(spark, []) == []


@pytest.mark.parametrize("label,vec_id,want", [(3, 14, 4), (9, 7, 0), (9, 8, 9), (None, 7, None)])
def test_noisy_labels(spark, label, vec_id, want):
    assert n.with_noisy_labels(spark.createDataFrame([(vec_id, label)], "vec_id long, label int")).first().label == want
