import re
import time

from siteloom.llm import license_rules, license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
# Openings of licences' own texts and of the notices that go with them.
MIT = 'MIT License\n\nCopyright (c) 2024 A B\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.'
BSD = "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n * 1. Redistributions of source code must retain the above copyright notice.\n * 2. Redistributions in binary form must reproduce the above copyright notice.\n * Neither the name of X nor the names of its contributors may be used to endorse or promote products\n * derived from this software without specific prior written permission."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# Unless required by law, software\n# distributed under the License is distributed on an "AS IS" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\nYou should have received a copy of the GNU General Public License"
ISC = "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"
ZLIB = "In no event will the authors be held liable for any damages arising from the use of this software. Altered source versions must be plainly marked as such"
TEXTS = [
    None, "", "nothing here", "Released under the MIT License.", "MIT\nLICENSE mit license", "mitlicense mit-license MIT, License!",
    "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License", "Lesser General Public License and the General Public License v2",
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0 OR MIT", "x İ LICENSE: BSD\nhttps://opensource.org/licenses/MIT",
    "general public  license general public licence", "é MIT License é", "é MIT Licenseé", "available under public domain", "under the terms", "license " * 3000, "mit license " * 500,
    MIT, BSD, APACHE, GPL, ISC, ZLIB, "All rights reserved.", "a\x01mit\x01license\x01b", "x" * 900 + " mit license " + "y" * 700 + " bsd license " + "z" * 2000 + " isc license", "the ruby license", "A Vim licence and the Ruby Licence, public domain license",
    "creative commons attribution 4.0 international licence; licensed under a Creative Commons Attribution-ShareAlike", "licensed to the apache software foundation under apache 2.0", "Mozilla Public\n * License, version 2.0",
]


def stretches(text):
    at = [m.start() for m in re.finditer("(?=" + "|".join(map(re.escape, license_rules.roots())) + ")", text)]
    out = []
    for o in at:
        if out and o - out[-1][1] <= 2 * license_scan.ABOUT:
            out[-1][1] = o
        else:
            out.append([o, o])
    return [(max(a - license_scan.ABOUT, 0), b + license_scan.ABOUT) for a, b in out]


def detections(t):
    out, side = [], 2 * license_scan.ABOUT
    for c in range(max(len(t) - 1, 0) // license_scan.PIECE + 1):
        lo, hi = c * license_scan.PIECE, (c + 1) * license_scan.PIECE
        start = max(lo - side, 0)
        piece, found, last = t[start : hi + side], [], None
        for a, b in stretches(piece):
            for label, keyword, regex, priority, weight in license_rules.rules():
                if keyword in piece[a:b]:
                    found += [(start + a + m.start(), -(start + a + m.end()), -priority, label, weight) for m in re.finditer(regex, piece[a:b], re.ASCII)]
        kept = []
        for d in sorted(found):
            if last is None or d[0] >= -last[1]:
                kept.append(d)
                last = d
            elif d[2] < last[2]:
                kept[-1] = last = d
        out += [(d[0], -d[1], -d[2], d[3], d[4]) for d in kept if lo <= d[0] < hi]
    return out


def brute(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x01", " ")
    words = WORD.findall(t)
    places = {label: [i for i in range(len(words)) if tuple(words[i : i + len(p)]) == p] for label, p in license_scan.BASE}
    kept = detections(t)
    base = sorted(label for label, p in places.items() if p)
    every = sum(places.values(), [])
    chance = 1.0
    for k in kept:
        chance *= 1 - k[4]
    return (len(words), len(every), min(every, default=None), max(every, default=None), ",".join(base), ",".join(sorted({*base, *(k[3] for k in kept)})), round(max(1 - chance, 0.5 if base else 0), 9), kept)


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int").repartition(3)
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9), [tuple(d) for d in r.detections]) for r in license_scan.scan(docs).collect()}


def test_against_brute_force(spark):
    got = scanned(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t), t


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "PIECE", 500)
    monkeypatch.setattr(license_scan, "ABOUT", 300)
    texts = ["".join(w + " " for w in [*("word " * k).split(), MIT, *("é " * 40).split(), GPL, "mit license"] * 4) for k in (0, 7, 90, 260)]
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t)
        assert {d[3] for d in got[i][7]} >= {"mit", "gpl"}


def test_rules_are_signatures():
    rules = license_rules.rules()
    assert len(rules) > 300 and len({r[2] for r in rules}) == len(rules)
    for label, keyword, regex, _, weight in rules:
        assert re.compile(regex) and not re.match(regex, "") and keyword == keyword.lower() and 0 < weight <= 1, label


def test_every_rule_finds_its_own_signature():
    """A text made of the signature, with its choices taken first and its options left out or in, passes gate and rule."""
    for (label, _, signature), (_, keyword, regex, _, _) in zip(license_rules.SIGNATURES, license_rules.rules()):
        text = signature.replace("{", "").replace("}", "").replace("licence", "license")
        text = re.sub(r"\[\^[^\]]*\]", "x", text)
        for _ in range(4):
            text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\?", "", text)
            text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", text)
        text = re.sub(r"\[0-9\.\]\* \?|\[-\[?ms\+\]\+|: \?", lambda m: ": " if m[0].startswith(":") else "", text).replace("(?:-", "")
        text = re.sub(r"\[- \]\??", " ", text)
        text = re.sub(r"\[([^\]-])[^\]]*\]\??", r"\1", text)
        text = re.sub(r"\\\+|\.\?|(?<!\\)\?", "", text).replace("\\", "")
        assert keyword in text, (label, text)
        assert any(r in text for r in license_rules.roots()), (label, text)
        assert re.search(regex, text), (label, text, regex)


def test_licence_bodies(spark):
    got = scanned(spark, [MIT, BSD, APACHE, GPL, ISC, ZLIB])
    assert [set(got[i][5].split(",")) for i in range(6)] == [{"mit"}, {"bsd", "bsd-3-clause"}, {"apache"}, {"gpl"}, {"isc"}, {"zlib"}]


def test_many_matches_in_one_text(spark):
    text = "released under the mit license\nsee the bsd license for this\n" * 50_000
    began = time.monotonic()
    (row,) = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(row.detections) == 100_000 and row.n_base == 50_000 and row.labels == "bsd,mit" and row.score == 1
    assert time.monotonic() - began < 60


def test_repeated_and_empty(spark):
    docs = spark.createDataFrame([(None, "MIT License"), (None, "MIT License")], "doc_id long, text string")
    assert [r.labels for r in license_scan.scan(docs).collect()] == ["mit", "mit"]
    assert license_scan.scan(docs.limit(0)).collect() == []
