import hashlib
import random

from siteloom.llm import sketch as s


def check(spark, rows):
    docs = spark.createDataFrame([(*x, "q", 5) for x in rows], "doc_id long, text string, edited string, part int").repartition(3)
    got = sorted(s.neighbours(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in order]
    want = []
    for i, (d, t) in enumerate(zip((x[0] for x in order), texts)):
        follow, k = texts[(i + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - k] + follow[:k]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((str(a), b, c) for a, b, c in want)
    by = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) % 16 == 0
        by.setdefault(r.doc_id, r)
    for d, t in rows:
        for e, u in rows:
            if d is not None and e is not None and (t or "") == (u or ""):
                assert by[d].fingerprint == by[e].fingerprint or sum(x[0] == d for x in rows) > 1
    return by


def test_order_and_edits(spark):
    r = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    rows = [(i * 7 % 101, " ".join(r.choice(words) for _ in range(r.choice((0, 1, 4, 30, 600))))) for i in range(101)]
    by = check(spark, [*rows, (500, rows[3][1])])
    long = [by[d] for d, t in rows if len(t) > 1500]
    assert min(x.near_edited for x in long) > 0.1 and max(x.near_next for x in long) < 0.1


def test_ties_nulls_and_few(spark):
    check(spark, [(None, "a b"), (None, None), (1, "é" * 3), (1, "é" * 3), (1, "x y"), (2, None), (3, "z " * 30_000)])
    one = check(spark, [(4, "a b c d e f")])[4]
    assert one.near_next == 1.0
    assert s.neighbours(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketch_rule(spark):
    text = " ".join("t%d" % i for i in range(3000))
    df = spark.createDataFrame([(text,), ("  ",), ("one",), ("\tone\n",)], "text string")
    a, b, c, d = (r.k for r in s.with_sketch(df, "text", "k").collect())
    assert b == [] and len(c) == 1 and c == d and a == sorted(set(a)) and 120 < len(a) < 260
    assert all(h < -(1 << 63) + (1 << 60) for h in a)
