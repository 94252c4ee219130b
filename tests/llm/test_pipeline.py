import random

import numpy as np

import corpus_pipeline
from siteloom.llm import simhash as s
from siteloom.llm.jaccard import Shingles


def similarity(a, b, k=5):
    bag = lambda t: {tuple(w[i : i + k]) for w in [t.lower().split()] for i in range(max(1, len(w) - k + 1))}
    x, y = bag(a), bag(b)
    return len(x & y) / len(x | y)


def test_near_copies_go_and_clean_documents_stay(spark):
    r = random.Random(8)
    words = ["w%d" % i for i in range(3000)]
    rows, groups = [], {}
    for g in range(40):
        text = [r.choice(words) for _ in range(r.choice((60, 200, 700)))]
        for c in range(1 if g % 2 else 6):
            near = list(text)
            for at in r.sample(range(len(text)), c * len(text) // 250):
                near[at] = "edit%d" % r.randrange(10**6)
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(near), "x"))
    docs = spark.createDataFrame(rows + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, u string").repartition(3)
    kept = {x.doc_id for x in s.distinct_documents(docs).collect()}
    alone = {d for d, g in groups.items() if g % 2}
    assert alone <= kept and 900 in kept and 901 not in kept
    first = {}
    for d, g in groups.items():
        first.setdefault(g, d)
    assert set(first.values()) <= kept
    copies = [d for d, g in groups.items() if d != first[g] and similarity(rows[d][1], rows[first[g]][1]) >= 0.8]
    missed = [d for d in copies if d in kept]
    assert len(copies) > 60 and len(missed) <= 0.05 * len(copies)


def test_fingerprints_of_sets():
    shingles = Shingles(5)
    none = shingles(" \n")
    assert s.set_fingerprint(none) == 0 == s.set_fingerprint(shingles(None))
    a, b = (s.set_fingerprint(shingles(" ".join("q%d" % i for i in range(n)))) for n in (900, 899))
    assert np.bitwise_count(np.uint64(a & (2**64 - 1)) ^ np.uint64(b & (2**64 - 1))) <= 2


def test_near_fingerprints_are_candidates(spark):
    from siteloom.llm.common import Scratch

    rows = [(1, 0), (2, 3), (3, 0), (4, 0b111), (5, -1), (6, -2), (7, 1 << 40)]
    got = s.fingerprint_candidates(spark.createDataFrame(rows, "rep long, fp long"), Scratch(spark, "test"))
    assert {tuple(x) for x in got.collect()} == {(3, 1), (2, 1), (4, 2), (6, 5), (7, 1)}


def test_odd_rows_and_names(spark):
    names = "doc_id long, text string, order_at int, row_at string, fp long, ORDER_AT_ int"
    docs = spark.createDataFrame([(1, "a b", 5, "x", 1, 1), (1, "a b", 6, "y", 2, 2), (None, "c", 7, None, 3, 3), (2, None, 8, "z", 4, 4), (3, "", None, "w", 5, 5), (4, "q " * 70_000, 9, "v", 6, 6)], names)
    kept = s.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted(r.order_at for r in kept.collect()) in ([5, 7, 8, 9], [6, 7, 8, 9])
    assert s.distinct_documents(docs.limit(0)).collect() == []
    assert s.near_duplicates(docs.limit(0)).collect() == []


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, sf)
        assert after.columns == names and 0.5 * docs.count() < after.count() <= docs.count(), name
        docs = after
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == docs.count() and out.where("not parity or not round_trip").count() == 0
