import random
from collections import Counter

import numpy as np

from siteloom.llm import decontaminate as d


def brute(docs, items, least=0.8, k=5):
    out = {}
    for doc_id, text in docs:
        w = d.words(text)
        for item_id, item in items:
            own = d.words(item)
            if not own:
                continue
            s = min(k, len(own))
            bag = lambda x: Counter(tuple(x[i : i + s]) for i in range(len(x) - s + 1))
            b, best = bag(own), 0
            for at in range(max(1, len(w) - len(own) + 1)):
                a = bag(w[at : at + len(own)])
                size = lambda c: sum(n * sum(map(len, g)) for g, n in c.items())
                if a:
                    best = max(best, size(a & b) / size(a | b))
            if best >= least:
                out[doc_id, item_id] = best
    return out


def case(seed):
    r = random.Random(seed)
    vocab = ["v%d" % i for i in range(900)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([1, 3, 4, 5, 14, 20, 33, 37, 48, 59, 120, 300, 420])]
    docs = []
    for i in range(120):
        body = text(r.choice((0, 3, 60, 500)))
        if i % 2:
            item = list(r.choice(items)[1])
            if i % 3 == 0 and len(item) > 50:
                item[len(item) // 2] = "edited"
            at = r.randrange(len(body) + 1)
            body[at:at] = item
        docs.append((i, " ".join(body)))
    docs += [(500, None), (501, ""), (502, " ".join(text(3000) + items[7][1]).upper()), (None, ", ".join(items[9][1]))]
    return docs, [(i, " ".join(t)) for i, t in items] + [(90, ""), (91, None), (92, " ".join(items[5][1]))]


def test_against_brute_force(spark):
    docs, items = case(1)
    got = d.leaks(spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(got) == len(want) > 40


def test_blocks_of_items(spark, monkeypatch):
    docs, items = case(2)
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, d.leaks(a, b).collect()))
    monkeypatch.setattr(d, "INDEX_ITEMS", 3)
    monkeypatch.setattr(d, "SLICE", 3000)
    assert sorted((str(r.doc_id), r.item_id) for r in d.leaks(a, b).collect()) == sorted((str(k[0]), k[1]) for k in brute(docs, items)) and whole


def test_index_misses_nothing():
    r = random.Random(3)
    index = d.Index([(i, " ".join("x%d" % r.randrange(999) for _ in range(20))) for i in range(6)], 5, 15)
    ids, marks, _ = index.sizes[5, 20]
    prints = np.array([int(m) ^ sum(1 << b for b in r.sample(range(64), r.randrange(20))) for m in marks for _ in range(300)], dtype=np.uint64)
    window, item, _ = index.near((5, 20), prints)
    got = set(zip(window.tolist(), item.tolist()))
    want = {(w, i) for w, p in enumerate(prints.tolist()) for i, m in zip(ids.tolist(), marks.tolist()) if (p ^ m).bit_count() <= 15}
    assert got == want and len(want) > 1000


def test_clean_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "x"), (1, "other words here", "x"), (None, "zz a b c d e f g", "y"), (2, None, "z")], "doc_id long, text string, __doc__ string")
    bench = spark.createDataFrame([(7, "A B C, d e f g")], "item_id long, text string")
    left = d.clean_documents(docs, bench)
    assert left.columns == docs.columns and sorted((str(r[0]), str(r[1])) for r in left.collect()) == [("1", "other words here"), ("2", "None")]
    assert d.clean_documents(docs.limit(0), bench).collect() == []
    assert d.clean_documents(docs, bench.limit(0)).count() == 4
