import math
from collections import Counter

import pytest

from kgloom.llm import op10_licenses as op


def bag(text):
    return Counter(w.encode() for w in op.tokens(text))


def files(spark, rows):
    return spark.createDataFrame([(i, p, t, "MIT", "x", 0.0) for i, (p, t) in enumerate(rows)], "id long, path string, text string, license string, own string, cosine double")


def test_headers_and_inheritance(spark, prose):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.txt", prose.text(30)), ("a/b/c/y.txt", None), ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), ("a/b/z.txt", ""), ("a/b/c/w.txt", prose.text(20) + "\nLicensed under CC BY-NC 4.0.\n" + prose.text(20)),
        ("other/v.txt", "A licence is a thing under which we work"), ("COPYING", "This work is licensed under the GNU General Public License, version 3."), (None, "Licensed under CC BY-NC 4.0."), ("ab/u.txt", "x"),
    ]
    rows += [(f"bulk/{i}.txt", prose.text(40)) for i in range(100)]
    out = {r["id"]: (r["own"], r["license"], r["license_from"]) for r in op.licenses(files(spark, rows)).collect()}
    assert out[0] == ("MIT", "MIT", "own") and out[1] == (None, "MIT", "a") and out[2] == (None, "Apache-2.0", "a/b") and out[4] == (None, "Apache-2.0", "a/b")
    assert out[5] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "own") and out[6] == (None, "GPL-3.0", "") and out[8] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "own") and out[9] == (None, "GPL-3.0", "")


def test_cosine_against_brute_force(spark, prose):
    idf = op.weights(files(spark, [("x", prose.text(20) + " the license")] * 50))
    scanner = op.Scanner(idf)

    def cosine(a, b):
        a, b = (Counter(op.tokens(x)) for x in (a, b))
        w = lambda t: idf.get(t, idf[""])
        dot = sum(a[t] * b[t] * w(t) ** 2 for t in a if t in b)
        return dot / math.sqrt(sum((n * w(t)) ** 2 for t, n in a.items()) * sum((n * w(t)) ** 2 for t, n in b.items()))

    for line in ["released under the mit license", "this work is licensed under the gnu general public license version 2", "licensed under some other license", prose.text(9)]:
        best = max((cosine(line, t), name) for name, ts in op.TEMPLATES.items() for t in ts)
        assert scanner.score(bag(line))[0] == pytest.approx(best[0])


def test_document_frequencies_cover_all_rows(spark):
    idf = op.weights(files(spark, [("x", "MIT license"), ("y", "mit"), ("z", None), ("w", "permit")]).repartition(3))
    assert idf["mit"] == pytest.approx(math.log(5 / 3) + 0.1)


def test_empty_and_repeated(spark):
    assert op.licenses(files(spark, [])).collect() == []
    df = files(spark, [("a/LICENSE", "Released under the MIT License.")])
    assert [r["license"] for r in op.licenses(df.union(df)).collect()] == ["MIT", "MIT"]


def test_very_long_text(spark, prose):
    text = prose.text(100_000) + "\nReleased under the MIT License."
    assert op.licenses(files(spark, [("a.txt", text)])).first()["own"] == "MIT"


def test_frequent_licences_are_found(spark, prose):
    """A header of most documents, all of whose words are frequent."""
    rows = [(f"d{i}/x.txt", prose.text(30) + ("\nReleased under the MIT License.\n" if i % 5 else "\n") + prose.text(30)) for i in range(200)]
    out = {r["id"]: (r["own"], r["license"]) for r in op.licenses(files(spark, rows)).collect()}
    assert out == {i: ("MIT", "MIT") if i % 5 else (None, None) for i in range(200)}


def test_bound_loses_no_run(prose):
    """All runs of lines against all templates, whatever the weights."""
    known = sorted(op.VOCABULARY)
    every = [t for ts in op.TEMPLATES.values() for t in ts]
    for _ in range(60):
        scanner = op.Scanner({w: prose.r.choice([0.1, 0.5, 2.0, 5.0]) for w in known} | {"": 5.1})
        lines = []
        for _ in range(prose.r.randint(1, 6)):
            words = [w for w in op.tokens(prose.r.choice(every))[:40] if prose.r.random() < 0.9] + prose.words(prose.r.randint(0, 3)) * prose.r.randint(1, 2) + [prose.r.choice(known)] * prose.r.randint(0, 2)
            cut = sorted(prose.r.sample(range(len(words) + 1), min(3, len(words))))
            lines += [" ".join(words[a:b]) for a, b in zip([0, *cut], [*cut, len(words)], strict=True)] + [""] * prose.r.randint(0, 1)
        best = 0.0
        for a in range(len(lines)):
            for b in range(a + 1, min(a + op.RUN, len(lines)) + 1):
                if all(lines[a:b]):
                    best = max(best, scanner.score(bag(" ".join(lines[a:b])))[0])
        got = scanner.scan("\n".join(lines).encode(), False)
        assert (got[1] or 0) >= best - 1e-9 if best >= op.THRESHOLD else got[0] is None or got[3] > op.RUN


HEADERS = {
    "GPL-3.0": """/*
 * Copyright (C) 2019 Some One
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */""",
    "GPL-2.0": """# This program is free software; you can redistribute it and/or
# modify it under the terms of the GNU General Public License
# as published by the Free Software Foundation; either version 2
# of the License, or (at your option) any later version.""",
    "Apache-2.0": """// Copyright 2020 The Authors.
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0""",
    "MIT": """MIT License

Copyright (c) 2021 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
}


@pytest.mark.parametrize("share", [1, 10])
def test_wrapped_headers_and_licence_files(spark, prose, share):
    """Of 300 documents all or a tenth hold a header, among code or prose, or are licence files."""
    names = sorted(HEADERS)
    rows = []
    for i in range(300):
        name = names[i // share % len(names)]
        body = prose.text(40) + "\n" + HEADERS[name] + "\n" + prose.text(40) if i % 2 else HEADERS[name]
        rows.append((f"d{i}/{'x.c' if i % 2 else 'LICENSE'}", body if i % share == 0 else prose.text(80)))
    out = {r["id"]: r["own"] for r in op.scan(files(spark, rows)).collect()}
    assert out == {i: names[i // share % len(names)] if i % share == 0 else None for i in range(300)}


def test_ties_and_nulls(spark):
    rows = [("a/LICENSE", "Released under the MIT License.\n\nReleased under the MIT License."), (None, None), ("a/b", None), ("", "")]
    out = {r["id"]: (r["own"], r["line"], r["lines"], r["license"]) for r in op.licenses(files(spark, rows)).collect()}
    assert out == {0: ("MIT", 0, 1, "MIT"), 1: (None, None, None, None), 2: (None, None, None, "MIT"), 3: (None, None, None, None)}


def test_headers_wrapped_to_many_lines_are_met_in_full(spark):
    """Headers of some 21 and 40 lines with code right above and below: the version that the whole header names."""
    texts, want = [], []
    for name in ("GPL-3.0", "GPL-2.0", "AGPL-3.0", "Apache-2.0"):
        header = max(op.TEMPLATES[name][:3], key=len)
        words = header.split()
        for each in (len(words) // 20, len(words) // 38):
            lines = [f"# {' '.join(words[k : k + each])}" for k in range(0, len(words), each)]
            assert len(lines) > op.RUN
            texts.append("\n".join(["import os", *lines, "x = compute(value)", "print(x)"]))
            want.append((name, len(lines)))
    df = spark.createDataFrame([(i, f"a/{i}.py", t) for i, t in enumerate(texts)] + [(100 + i, f"b/{i}.py", "plain words here " * 30) for i in range(50)], "id long, path string, text string")
    out = {r["id"]: r for r in op.licenses(df).collect()}
    for i, (name, n) in enumerate(want):
        assert out[i]["own"] == name and out[i]["cosine"] > 0.95 and (abs(out[i]["lines"] - n) <= 2 or name == "Apache-2.0"), (name, out[i])  # Apache's first sentence is a template too
    assert all(out[100 + i]["own"] is None for i in range(50))
