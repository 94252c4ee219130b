import random
from collections import defaultdict

from siteloom.llm import simhash as s


def shingles(text, k=5):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def kept(rows, least=0.8):
    """Brute force: doc_ids that are the least of their group, groups closed over all pairs that share a shingle."""
    sets, label, where = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}, defaultdict(list)

    def root(d):
        while label[d] != d:
            label[d] = label[label[d]]
            d = label[d]
        return d

    common = defaultdict(int)
    for d, own in sets.items():
        for x in own:
            for o in where[x]:
                common[o, d] += 1
            where[x].append(d)
    for (a, b), both in common.items():
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {d for d in label if root(d) == d}


def got(spark, rows):
    return {x.doc_id for x in s.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}


def test_all_copies_go_among_many_rows(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w%d" % r.randrange(9999) for _ in range(60))) for i in range(3000)]
    for i in range(300):  # 56 of 60 to 72 shingles are shared
        rows.append((5000 + i, rows[i][1] + "".join(" e%d" % r.randrange(10**9) for _ in range(4 + i % 13))))
    want = kept(rows)
    assert got(spark, rows) == want and 3000 < len(want) < 3050


def test_strangers_with_shared_passages_hide_no_copies(spark):
    r = random.Random(2)
    passage = ["p%d" % i for i in range(70)]
    rows = [(i, " ".join([*passage, *("w%d" % r.randrange(9999) for _ in range(30))])) for i in range(2500)]  # 66 of 126 shared
    rows += [(5000 + i, rows[i][1] + "".join(" e%d" % r.randrange(10**9) for _ in range(10))) for i in range(500)]  # 96 of 106
    assert got(spark, rows) == set(range(2500))


def test_verdict_is_by_exact_shingles(spark):
    r = random.Random(3)
    rows = []
    for i in range(150):  # 40 shingles; 32 of 40, or 32 of 41
        text = ["w%d" % r.randrange(10**9) for _ in range(44)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:36] + ["x"] * (i % 2)))]
    want = kept(rows)
    assert got(spark, rows) == want and len(want) == 225
