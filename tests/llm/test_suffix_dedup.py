import hashlib
import random

import numpy as np
import pyarrow as pa

from siteloom.llm import suffix_dedup as s


def brute(rows, window):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            w = data[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=80):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdé \n") for _ in range(k))
    line, shared = text(150), [text(r.randrange(90, 700)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(r.randrange(0, 400)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, line)
        if i % 4 == 0:
            parts.insert(r.randrange(4), r.choice(shared))
        if i % 5 == 0:
            a = r.choice(shared)
            parts.insert(0, a[: len(a) // 2] + "X" + a[len(a) // 2 :])
        rows.append((i * 2, "".join(parts)))
    rows += [(1001, "ab" * 400), (1003, "a" * 99), (1005, "a" * 100), (1007, "a" * 101), (1009, None), (1011, ""), (3, rows[0][1]), (5, rows[0][1])]
    r.shuffle(rows)
    return rows


def check(spark, rows, window=100, trigger=24):
    docs = spark.createDataFrame([(*x, 1, "q") for x in rows], "doc_id long, text string, pos int, runs_ string").repartition(3)
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, s.repeat_digests(docs, window, trigger).collect()), key=key) == sorted(brute(rows, window), key=key)


def test_against_brute_force(spark):
    check(spark, corpus(1))


def test_cut_slices_and_other_windows(spark, monkeypatch):
    monkeypatch.setattr(s, "SLICE", 257)
    rows = corpus(2, 30)
    keys, texts = [x[0] for x in rows], [(x[1] or "").encode() for x in rows]
    got = sum(int(c["n"].sum()) for c in s.phrases(keys, texts, 40, 8))
    assert got == sum(max(0, len(t) - 39) for t in texts)
    monkeypatch.undo()
    check(spark, corpus(3, 40), 31, 7)


def repeats(pieces, batch=7):
    """What Repeats makes of rows of pieces(), sorted and fed in small batches."""
    rows = sorted((tuple(x) for c in pieces for x in zip(*c.values())), key=lambda r: r[:4])
    state, out = s.Repeats(100), []
    for i in range(0, len(rows), batch):
        columns = list(zip(*rows[i : i + batch]))
        out += state.feed(*(np.array(c, np.int64) for c in columns[:5]), pa.array(columns[5], pa.binary()))
    out.append(state.flush())
    return [(int(d), int(p) + k) for docs, places, sizes in out for d, p, n in zip(docs, places, sizes) for k in range(int(n))]


def test_suffix_classes_and_strings_on_their_own(monkeypatch):
    texts = [(i, (t or "").encode()) for i, (_, t) in enumerate(corpus(5, 20))]
    seen, want = set(), []
    for i, t in texts:
        for a in range(len(t) - 99):
            if t[a : a + 100] in seen:
                want.append((i, a))
            seen.add(t[a : a + 100])
    for crowd in (1, s.CROWD + 1):
        runs = [(i, t, [{"trig": 5, "pos": 0, "n": len(t) - 99, "crowd": crowd}]) for i, t in texts if len(t) > 99]
        assert sorted(repeats(s.pieces(runs, 100))) == want and want
    monkeypatch.setattr(s, "SORTED", 50)  # other triggers, other batches
    runs = [(i, t + t, [{"trig": 900 - i, "pos": 0, "n": 2 * len(t) - 99, "crowd": 2}]) for i, t in texts if len(t) > 99]
    assert {d for d, _ in repeats(s.pieces(runs, 100))} >= {i for i, t in texts if len(t) > 99}


def test_hot_and_crowded_triggers(spark, monkeypatch):
    monkeypatch.setattr(s, "CROWD", 3)
    monkeypatch.setattr(s, "HOT", 4)
    monkeypatch.setattr(s, "SAMPLE", 1)
    monkeypatch.setattr(s, "PARTS", 5)
    check(spark, corpus(6))
    monkeypatch.setattr(s, "HOT", 10**9)
    check(spark, corpus(7, 50))


def test_bytes_of_zero_and_endings(spark):
    z = "\0" * 150
    check(spark, [(1, z), (2, "a" + z), (3, z[:100] + "b"), (4, "\0" * 99), (5, "c" * 100 + "\0"), (6, "c" * 100), (7, "d" + "c" * 100)])


def test_repeated_and_null_ids(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(300))
    check(spark, [(1, long), (1, long), (None, long + "x"), (None, None), (2, "y" + long), (2, "z" + long[:150])])


def test_empty_and_clashing_names(spark):
    assert s.repeat_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    names = "doc_id long, text string, order_at long, runs string, doc string, ORDER_AT_ long, row_at int, pos int"
    assert s.cleaned_documents(spark.createDataFrame([], names)).collect() == []
    rows = [(1, "x" * 120, 77, "r", "d", 5, 6, 7), (1, "x" * 120, 78, None, "d", 5, 6, 7), (None, "y", None, "q", None, None, None, None)]
    docs = spark.createDataFrame(rows, names)
    assert sorted(map(tuple, s.cleaned_documents(docs).drop("text").collect()), key=repr) == sorted((r[:1] + r[2:] for r in rows), key=repr)
    assert s.cleaned_documents(docs).columns == docs.columns


def test_cleaned_text_keeps_whole_characters(spark):
    a = "é" * 150 + "b"
    docs = spark.createDataFrame([(1, "x" + a, "en", 152), (2, a, "en", 151), (3, None, None, None)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in s.cleaned_documents(docs).collect()}
    assert got[3] == (None, None) and got[2] == ("", 0) and got[1][0].startswith("xé")
