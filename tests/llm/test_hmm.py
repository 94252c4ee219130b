import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from siteloom.llm import hmm as h


def plain_forward(m, text):
    v, total = m.start * m.emit[text[0]], 0.0
    for s in text[1:]:
        scale = v.sum()
        total += math.log10(scale)
        v = (v / scale) @ m.move * m.emit[s]
    return total + math.log10(v.sum())


def model(k=3, n=40, seed=5):
    r = np.random.default_rng(seed)
    rows = lambda *s: (x := r.random(s) + 0.01) / x.sum(axis=-1, keepdims=True)
    return h.Model(rows(k), rows(k, k), rows(k, n).T)


def test_stretches_equal_the_plain_recursion():
    m, r = model(), np.random.default_rng(1)
    texts = [r.integers(0, 40, n) for n in (1, 2, 127, 128, 129, 256, 257, 5000, 3)]
    assert np.allclose(h.log_likelihoods(m, texts), [plain_forward(m, t) for t in texts], rtol=1e-10)


def test_expected_counts_equal_plain_forward_backward():
    m, r = model(), np.random.default_rng(2)
    texts = [r.integers(0, 40, n) for n in (1, 5, 300, 128)]
    starts, moves, flat, states = h._Slice(m, texts).expected()
    want_s, want_m, want_e = np.zeros(3), np.zeros((3, 3)), np.zeros((40, 3))
    for t in texts:
        a, b = [m.start * m.emit[t[0]]], [np.ones(3)]
        for s in t[1:]:
            a.append(a[-1] @ m.move * m.emit[s])
            a[-1] /= a[-1].sum()
        for s in t[:0:-1]:
            x = m.move @ (m.emit[s] * b[0])
            b.insert(0, x / x.sum())
        g = [x * y / (x * y).sum() for x, y in zip(a, b)]
        want_s += g[0]
        for s, x in zip(t, g):
            want_e[s] += x
        for i in range(1, len(t)):
            x = a[i - 1][:, None] * m.move * (m.emit[t[i]] * b[i])[None]
            want_m += x / x.sum()
    got_e = np.stack([np.bincount(flat, states[:, j], minlength=40) for j in range(3)], axis=1)
    assert np.allclose(starts, want_s) and np.allclose(moves, want_m) and np.allclose(got_e, want_e)


def rows(seed=3):
    r = random.Random(seed)
    a, b = ["a%d" % i for i in range(30)], ["b%d" % i for i in range(30)]
    out = [(i, " ".join(r.choice(r.choice((a, a, b)) if r.random() < 0.02 else (a if i % 2 else b)) for _ in range(r.choice((1, 40, 400))))) for i in range(150)]
    return out + [(900, None), (901, ""), (902, "\tA1\nB1 neverseen neverseen"), (903, "é " * 9000), (None, "a1 a2")]


def test_base_and_model(spark):
    data = rows()
    docs = spark.createDataFrame([(*x, 1.5) for x in data] + [(5, "b1", 0.1), (5, "b1", 0.1)], "doc_id long, text string, score double").repartition(3)
    data += [(5, "b1")] * 2
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, _ in data}
    split = lambda t: [w.encode() for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    toks = lambda t: [bytes(x + 32 if 65 <= x <= 90 else x for x in w) for w in split(t)] + [b""]
    c = Counter(w for d, t in data if not held[d] for w in toks(t))
    n, v = sum(c.values()), len(c)
    got = h.score(docs, states=2, rounds=3, top=20, rare=8, own=3).collect()
    assert len(got) == len(data)
    want = sorted((str(d), held[d], len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for d, t in data)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert all(r.score < 0 for r in got) and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert h.score(none, rounds=1).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    one = h.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), rounds=1).collect()[0]
    assert (one.n_known, one.train_tokens, one.base_score) == (0, 0, 0.0)


def test_training_equals_one_plain_table(spark):
    """Expected counts, updates and scores against a recursion over one table in one place."""
    r = random.Random(5)
    data = [(i, " ".join("ab"[i % 2] + str(int(r.expovariate(0.08))) for _ in range(r.choice((3, 30, 200))))) for i in range(60)]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in data}
    states, rare, own = 2, 4, 3
    toks = {d: [w.encode() for w in t.split()] + [b""] for d, t in data}
    c = Counter(w for d in toks if not held[d] for w in toks[d])
    n = sum(c.values()) + len(c) + 1
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for top in (0, 7, 10**6):
        order = sorted(c, key=lambda w: (-c[w], w))
        place = {w: i for i, w in enumerate(order[:top])}
        able = {w: i for i, w in enumerate(w for w in order[top:] if c[w] >= own)}
        first = len(place)
        tie = lambda w: place.get(w, first + zlib.crc32(w) % rare)  # noqa: B023, E731
        symbol = lambda w: first + rare + able[w] if w in able else tie(w)  # noqa: B023, E731
        tied, free = np.array([(c[w] + 1) / n for w in place] + [1 / n] * rare), np.array([(c[w] + 1) / n for w in place] + [1 / n] * rare + [(c[w] + 1) / n for w in able])
        for w in order[top:]:
            tied[tie(w)] += (c[w] + 1) / n
            if w not in able:
                free[tie(w)] += (c[w] + 1) / n
        m = h.begin(tied / tied.sum(), states)
        train = [d for d in toks if not held[d]]
        for last in (False, False, True):
            s, mv, _, at = h._Slice(m, [np.array([tie(w) for w in toks[d]]) for d in train]).expected()
            unigram, flat = (free, [symbol(w) for d in train for w in toks[d]]) if last else (tied, [tie(w) for d in train for w in toks[d]])
            e = np.stack([np.bincount(flat, at[:, j], minlength=len(unigram)) for j in range(states)], axis=1) + h.PRIOR * unigram[:, None]
            m = h.Model((s + 1) / (s + 1).sum(), (mv + 1) / (mv + 1).sum(axis=1, keepdims=True), e / e.sum(axis=0))
        got = {x.doc_id: x.score for x in h.score(docs, states=states, rounds=3, top=top, rare=rare, own=own).collect()}
        for d in toks:
            choice = sum(math.log10((c[w] + 1) / (free[tie(w)] * n)) for w in toks[d] if w not in place and w not in able)
            assert math.isclose(got[d], plain_forward(m, [symbol(w) for w in toks[d]]) + choice, rel_tol=1e-9)


def test_tokens():
    texts = ["", None, "  A b\x0bC\x1cd  ", "é É\tZ", "\n", "x"]
    flat, counts = h.tokens(pa.array(texts))
    want = [[bytes(x + 32 if 65 <= x <= 90 else x for x in w) for w in (t or "").encode().split()] + [b""] for t in texts]
    assert flat.to_pylist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert h.tokens(pa.array(texts).slice(2, 2))[0].to_pylist() == want[2] + want[3] and len(h.tokens(pa.array([], pa.string()))[0]) == 0


def test_tokens_of_slices():
    texts = [x for _, x in rows(4)]
    for at in range(0, len(texts) - 5, 7):
        part = pa.array(texts).slice(at, 5)
        assert h.tokens(part)[0].to_pylist() == [w for x in part.to_pylist() for w in [*(x or "").lower().encode().split(), b""]]


def test_slabs_of_any_size(spark, monkeypatch):
    data = rows(4)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    want = sorted((str(r.doc_id), round(r.score, 6)) for r in h.score(docs, 2, 2, 10, 4, 3).collect())
    monkeypatch.setattr(h, "SLAB", 5)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in h.score(docs, 2, 2, 10, 4, 3).collect()) == want


def test_slabs_outgrow_the_batches(spark):
    """A slab holds SLAB tokens however few rows Spark sends at once, and only counts that slabs can't know are sent."""
    docs = spark.createDataFrame([(i, f"common own{i}") for i in range(50)], "doc_id long, text string").withColumn("held_out", h.held_out())
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        assert [len(r.doc_id) for r in h.slabs(docs.coalesce(1)).collect()] == [50]
        apart = h.counted(h.slabs(docs.repartition(2, "doc_id"))).where("not alone").collect()
    finally:
        spark.conf.set(key, before)
    assert len(apart) == 4  # the common word and the end, in each of two slabs
