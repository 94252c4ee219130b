import random
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa

from siteloom.llm import jaccard as j


def shingles(text, k=5):
    w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").split() if x]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, num=80, den=100):
    """(doc_id, n, component) of rows with distinct, known doc_ids, by all pairs that share a shingle."""
    sets, label, where, common = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}, defaultdict(list), defaultdict(int)

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for d, own in sets.items():
        for x in own:
            for o in where[x]:
                common[o, d] += 1
            where[x].append(d)
    for (a, b), both in common.items():
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return sorted((d, len(sets[d]), root(d)) for d in sets)


def got(spark, rows, **more):
    docs = spark.createDataFrame([(*x, 3, "q") for x in rows], "doc_id long, text string, n long, rep string").repartition(3)
    return sorted(map(tuple, j.near_documents(docs, **more).collect()))


def corpus(seed, n=400):
    """Copies edited here and there, strangers that share most of their text, sets at the very limit."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(10**9)
    rows, template = [], [word() for _ in range(120)]
    for i in range(n):
        kind = i % 4
        if kind == 0 or i < 8:
            text = [word() for _ in range(r.choice((1, 3, 5, 40, 300)))]
        elif kind == 1:  # a copy of an earlier text with some words changed
            text = r.choice(rows)[1].split()
            for _ in range(r.choice((0, 1, 1, 2, 3))):
                text[r.randrange(len(text))] = word()
        elif kind == 2:  # much of a template, near the limit
            cut = r.randrange(90, 121)
            text = template[:cut] + [word() for _ in range(r.randrange(0, 40))]
        else:  # 40 shingles, of which 36 or 35 are shared: 36/44 and 35/45
            base = [word() for _ in range(44)]
            rows.append((10_000 + i, " ".join(base)))
            k = r.choice((4, 5))
            text = base[:-k] + [word() for _ in range(k)]
        rows.append((i, " ".join(text).upper() if i % 7 == 0 else " ".join(text)))
    return rows


def test_against_brute_force(spark):
    rows = corpus(1)
    want = brute(rows)
    assert got(spark, rows) == want and len({c for _, _, c in want}) < len(want) - 60


def test_small_slices_salts_and_memory(spark, monkeypatch):
    """Lists dealt in slices and parts, and tables that overflow, change nothing."""
    for name, value in (("SLICE", 7), ("SALTED", 3), ("SEEN", 2), ("LEAF", 3), ("FAN", 2), ("KNOWN", 50), ("COUNTED", 500)):
        monkeypatch.setattr(j, name, value)
    rows = corpus(2, 250)
    assert got(spark, rows) == brute(rows)


def test_large_groups_of_near_copies(spark):
    r = random.Random(3)
    base = [["g%d_%d" % (g, i) for i in range(100)] for g in range(3)]
    rows = []
    for i in range(450):
        own = list(base[i % 3])
        own[r.randrange(100)] = "x%d" % i
        rows.append((i, " ".join(own)))
    want = brute(rows)
    assert got(spark, rows) == want and {c for _, _, c in want} == {0, 1, 2}


def test_nulls_ties_repeats_and_empty(spark):
    long = " ".join("z%d" % i for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, long), (8, long + " end"), (9, "é É"), (10, "É É")]
    assert got(spark, rows) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 59_996, 7), (8, 59_997, 7), (9, 1, 9), (10, 1, 10)]
    key = lambda x: tuple((v is not None, v) for v in x)
    docs = spark.createDataFrame([(5, "k l m"), (5, "k l m"), (5, "other"), (6, "k l m"), (None, "k l m"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, j.near_documents(docs).collect()), key=key) == [(None, 0, None), (None, 1, None), (5, 1, 5), (5, 1, 5), (5, 1, 5), (6, 1, 5)]
    assert j.near_documents(docs.limit(0)).collect() == []


def test_other_similarity_and_words(spark):
    rows = [(1, "a b c d"), (2, "a b c e"), (3, "a b x y"), (4, "q")]
    assert got(spark, rows, words=1, least=0.6) == [(1, 4, 1), (2, 4, 1), (3, 4, 3), (4, 1, 4)]
    assert got(spark, rows, words=1, least=0.3) == [(1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 1, 4)]


def sets(seed, n, size=120):
    r = np.random.default_rng(seed)
    core = r.integers(-(2**63), 2**63 - 1, (4, size), dtype=np.int64)
    return [np.unique(np.concatenate((core[i % 4][: r.integers(size // 2, size + 1)], r.integers(-(2**63), 2**63 - 1, r.integers(0, size), dtype=np.int64)))) for i in range(n)]


def test_points_bound_the_overlap():
    own = [*sets(1, 30), np.arange(5000, dtype=np.int64) * 64, np.zeros(0, np.int64)]  # all of the last but one in few groups
    for a, b in combinations(own, 2):
        x, y = (j.counts_of(j.packed(s)) for s in (a, b))
        over, groups = min(len(a) - int(x.sum()), len(b) - int(y.sum())), min(len(x), len(y))
        assert int(np.minimum(j.folded(x, groups), j.folded(y, groups)).sum()) + over >= len(np.intersect1d(a, b))


def test_tree_misses_no_pair():
    least = Fraction(4, 5)
    for seed in range(6):
        own = sets(seed, 150, 30 * (seed + 1))
        n, component = np.array([len(s) for s in own]), np.arange(150) // (1 + seed % 2)
        tree = lambda at: j.Tree(np.array(at), component[at], n[at], [j.counts_of(j.packed(own[i])) for i in at], least)  # noqa: B023, E731
        similar = {(b, a) for a, b in combinations(range(150), 2) if component[a] != component[b] and 9 * len(np.intersect1d(own[a], own[b])) >= 4 * (n[a] + n[b])}
        found = list(zip(*(x.tolist() for x in tree(list(range(150))).pairs())))
        assert similar <= set(found) and len(found) == len(set(found)) < 150 * 149 / 4
        across = set(zip(*(x.tolist() for x in tree(list(range(70))).pairs(tree(list(range(70, 150)))))))
        assert across == {(u, v) for u, v in found if v < 70 <= u}
        forest = list(zip(*(x.tolist() for x in tree(list(range(150))).pairs(forest=True))))
        assert set(forest) <= set(found) and len(forest) < 150

        def joined(pairs):
            label = dict(enumerate(component.tolist()))  # noqa: B023
            for u, v in pairs:
                x, y = label[u], label[v]
                label = {k: min(x, y) if c in (x, y) else c for k, c in label.items()}
            return label

        assert joined(forest) == joined(found)


def test_lists_of_any_batching():
    r = random.Random(5)
    rows = sorted({(r.randrange(12), 0, r.randrange(3), r.randrange(6), 0) for _ in range(60)} | {(50, s, 1, k, 0) for s, k in ((1, 5), (2, 6), (2, 7))} | {(60, 0, 1, 1, 0)})
    rows = sorted(rows + rows[::5])
    by = defaultdict(list)
    for x in dict.fromkeys(rows):
        by[x[:2]].append(x)
    want = [(*x, *own[0][2:]) for own in by.values() if len(own) > 1 or own[0][1] for x in own]
    for size in (1, 2, 7, 1000):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        out = j.lists(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*p)], names=list("tsnkp")) for p in parts)
        assert [tuple(x.values()) for b in out for x in b.to_pylist()] == want
