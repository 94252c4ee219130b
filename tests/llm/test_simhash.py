import random

import numpy as np
import xxhash

from siteloom.llm import simhash as s


def brute(rows):
    def fp(text):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        if not words:
            return 0
        k = min(3, len(words))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {d: fp(t) for d, t in rows}
    label = {d: d for d in fps if d is not None}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = list(label)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: ("%016x" % f, root(d) if d is not None else None) for d, f in fps.items()}


def test_links_are_complete(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << x for x in r.sample(range(64), r.randrange(5))) for b in base for _ in range(12)} | {0, 1, 3, 7}
    signed = [np.uint64(f).astype(np.int64).item() for f in fps]
    got = {frozenset((x.a, x.b)) for x in s.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(2), 2).collect()}
    want = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want and len(want) > 50


def test_against_brute_force(spark):
    r = random.Random(2)
    words = ["w%d" % i for i in range(50)]
    rows = []
    for i in range(0, 120, 3):
        text = [r.choice(words) for _ in range(r.choice((1, 2, 5, 200)))]
        near = list(text)
        near[0] = "Edit"
        rows += [(i, " ".join(text)), (i + 1, "\n".join(near)), (i + 2, "\t ".join(text).upper())]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (None, "one"), (504, "é " * 40_000)]
    docs = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, component_id int")
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in s.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_repeated_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (0, "a b c d")], "doc_id long, text string")
    assert sorted((x.doc_id, x.component_id) for x in s.near_duplicates(docs).collect()) == [(0, 0), (1, 0), (1, 0)]
    assert s.near_duplicates(docs.limit(0)).collect() == []


def test_visitors_are_never_broadcast(spark):
    """A table of fingerprints is small by its files, what it sends to the anchors is not."""
    fps = spark.createDataFrame([(i * 7919,) for i in range(2000)], "fp long").repartition(2)
    plan = s.links(fps, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
