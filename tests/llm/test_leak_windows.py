import random

from siteloom.llm import decontaminate as d


def text(r, n):
    return ["v%d" % r.randrange(9000) for _ in range(n)]


def test_last_document_of_a_slice():
    r = random.Random(1)
    for n, part in ((46, 46), (59, 50), (20, 20), (15, 15), (37, 37)):
        item = text(r, n)
        index = d.Index([(7, " ".join(item))], 5, 15)
        for before in range(95, 106):
            found = list(d.search(index, [" ".join(text(r, before)), " ".join(item[:part])], 0.8))
            assert [f[:2] for f in found] == [(1, 7)] and found[0][3] == 0, (n, part, before)


def test_edited_copies_of_every_size():
    r = random.Random(2)
    for n in (15, 22, 29, 37, 43, 49, 54, 59, 130):
        item, docs, want = text(r, n), [], set()
        index = d.Index([(0, " ".join(item))], 5, 15)
        bag = d._bag(d.shingle_hashes(d.word_hashes(d.words(" ".join(item))), 5), d.words(" ".join(item)), 5)
        for i in range(600):
            near = list(item)
            near[r.randrange(n)] = "edit%d" % r.randrange(9)
            w = d.words(" ".join(near))
            if d.similarity(d._bag(d.shingle_hashes(d.word_hashes(w), 5), w, 5), bag) >= 0.8:
                want.add(i)
            docs.append(" ".join([*text(r, r.randrange(90)), *near, *text(r, r.randrange(90))]))
        assert want <= {f[0] for f in d.search(index, docs, 0.8)} and (n < 45 or want), n


def test_long_text():
    r = random.Random(3)
    items = [(i, " ".join(text(r, n))) for i, n in enumerate((15, 48, 420))]
    body = text(r, 30_000)
    for i, at in ((0, 29_000), (1, 17_001), (2, 7)):
        body[at:at] = items[i][1].split()
    found = {f[1]: f[2:] for f in d.search(d.Index(items, 5, 15), [" ".join(body)], 0.8)}
    assert {i: f[0] for i, f in found.items()} == {0: 1, 1: 1, 2: 1} and all(f[3] == 0 for f in found.values())
