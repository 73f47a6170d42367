"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

Candidates are all runs of up to ``RUN`` lines inside a block (lines with words, up to one without), so headers may be wrapped
and stand in comments; the best of these carried on as long as its cosine rises, so that headers wrapped to more lines are met in full;
whole blocks, whatever their length; and of licence files the whole text. Each is a sparse vector of its
words, weighted by inverse document frequency over the corpus (words outside the templates weigh like the rarest). Templates are
statements, the headers that licences ask for, and the texts or title blocks of licence files. Candidates that an exact
bound keeps under the threshold aren't compared; how frequent a word is rules out nothing. A document's own licence is
the template of the highest cosine, from a threshold on. A document without one takes that of the nearest directory
above it, its own first, that holds a licence file, found by joins of paths.

Null or empty texts have no licence of their own, but inherit; null paths neither; ties go to the first run by place, the shorter
one, and the first template by name; of several licence files in a directory the first by path counts. Repeated rows each get their
result; an empty table gives an empty result; further columns are left alone. Directories, not files, are joined upwards, so that one
directory of many files is one row.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, texts


def gnu(kind: str, version: str, year: str) -> tuple[str, ...]:
    """The statement, header and title block of a GNU licence."""
    name = f"GNU {kind}General Public License"
    published = f"under the terms of the {name} as published by the Free Software Foundation"
    return (
        f"This work is licensed under the {name}, version {version}.",
        f"This program is free software: you can redistribute it and/or modify it {published}, either version {version} of the License, or (at your option) any later version.",
        f"This program is free software; you can redistribute it and/or modify it {published}; either version {version} of the License, or (at your option) any later version.",
        f"{name} Version {version}, {year} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        f"SPDX-License-Identifier: {({'Affero ': 'A', 'Lesser ': 'L'}).get(kind, '')}GPL-{version}.0-or-later",
    )


# Sentences by which public licences name themselves, the headers they ask for, and their own texts.
WARRANTY = "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
MIT_REST = (
    f"The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", {WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
ISC_TEXT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
UNLICENSE_TEXT = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
TEMPLATES = {
    "AGPL-3.0": gnu("Affero ", "3", "19 November 2007"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", APACHE_HEADER, APACHE_HEADER.partition(" You may obtain")[0], "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-2-Clause": ("Use of this source code is governed by the BSD 2-Clause License.", BSD_TWO, "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Use of this source code is governed by the BSD 3-Clause License.", f"{BSD_TWO} {BSD_THIRD}", BSD_THIRD, "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL-2.0": gnu("", "2", "June 1991"),
    "GPL-3.0": gnu("", "3", "29 June 2007"),
    "ISC": ("Licensed under the ISC License.", ISC_TEXT, "SPDX-License-Identifier: ISC"),
    "LGPL-3.0": gnu("Lesser ", "3", "29 June 2007"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", MIT_GRANT, f"MIT License {MIT_GRANT} {MIT_REST}", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", UNLICENSE_TEXT),
}
WORD = re.compile(rb"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
#: Least cosine; lines of a run to begin with, and of each step that carries one on; names of licence files.
THRESHOLD, RUN = 0.6, 12
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.\-][^/]*)?$"


def tokens(text: str) -> list[str]:
    """Words with A-Z lower-cased."""
    return [w.decode() for w in WORD.findall(text.encode("utf-8", "replace").lower())]


VOCABULARY = sorted({w for ts in TEMPLATES.values() for t in ts for w in tokens(t)})


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each task and those that hold each word of the templates."""
    known = {w.encode() for w in VOCABULARY}
    found: Counter[bytes] = Counter()
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        found[b""] += batch.num_rows
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            found.update(known.intersection(WORD.findall(data[a:b].tobytes().lower())))
    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def weights(files: DataFrame) -> dict[str, float]:
    """IDF of the templates' words over all documents: as many rows as the templates have words."""
    n = {r["word"]: r["n"] for r in files.select("text").mapInArrow(count_rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) + 0.1 for w in ["", *VOCABULARY]} | {"": math.log(1 + n.get("", 0)) + 0.1}


class Scanner:
    def __init__(self, idf: dict[str, float]):
        self.idf, self.rarest = {w.encode(): x for w, x in idf.items() if w}, idf[""]
        self.templates = [(name, v, self.norm(v)) for name, ts in sorted(TEMPLATES.items()) for t in ts for v in [Counter(w.encode() for w in tokens(t))]]
        #: A candidate reaches the threshold only if its squared length inside the templates' words is this times that outside.
        self.price = (THRESHOLD**2 - 1e-9) / (1 - THRESHOLD**2) * self.rarest**2

    def norm(self, v: Counter[bytes]) -> float:
        return math.sqrt(sum((n * self.idf.get(w, self.rarest)) ** 2 for w, n in v.items()))

    def inside(self, v: Counter[bytes]) -> float:
        """The squared length in the templates' words."""
        return sum((n * self.idf[w]) ** 2 for w, n in v.items() if w in self.idf)

    def may_reach(self, inside: float, others: int) -> bool:
        """False only if a candidate of this squared length inside the templates' words, and so many others, is under the threshold for every template.

        Its cosine to any is at most sqrt(inside / (inside + outside)), the part of its squared length that lies in the
        templates' words; repeated words outside only lengthen it further.
        """
        return inside > 0 and inside >= self.price * others

    def score(self, v: Counter[bytes]) -> tuple[float, str]:
        """The highest cosine and its template."""
        size = self.norm(v) or 1.0
        best = (0.0, "")
        for name, t, norm in self.templates:
            s = sum(n * t[w] * self.idf[w] ** 2 for w, n in v.items() if w in t) / (size * norm)
            if s > best[0] + 1e-12:
                best = (s, name)
        return best

    def runs(self, raw: bytes, begin: array, end: array, seeds: list[int], whole: bool) -> Iterator[tuple[int, int, Counter[bytes]]]:
        """(first line, lines, words) of a block's runs that may reach the threshold; each holds a seed. begin, end: the block's lines."""
        n = len(begin)
        near = sorted({k for s in seeds for k in range(max(0, s - RUN + 1), s + 1)})
        for a in near:
            v: Counter[bytes] = Counter()
            next_seed = next(s for s in seeds if s >= a)
            for b in range(a, min(a + RUN, n)):
                v.update(WORD.findall(raw, begin[b], end[b]))
                if b >= next_seed and self.may_reach(self.inside(v), sum(k for w, k in v.items() if w not in self.idf)):
                    yield a, b + 1 - a, v
        if whole and n > RUN:
            yield 0, n, Counter(w for b in range(n) for w in WORD.findall(raw, begin[b], end[b]))

    def candidates(self, raw: bytes) -> Iterator[tuple[int, int, Counter[bytes]]]:
        """(first line, lines, words) of all that may reach the threshold.

        The squared length of RUN lines together is at most RUN times the sum of theirs, so a run that reaches the threshold holds a
        seed: a line that would reach it if its part inside counted RUN times. The summed weight squared, a simpler bound, tells most lines.
        """
        begin, end, seeds, known, others, at, line, first, idf = array("q"), array("q"), [], Counter(), 0, 0, 0, 0, self.idf
        while at <= len(raw):
            stop = raw.find(b"\n", at)
            stop = len(raw) if stop < 0 else stop
            words = WORD.findall(raw, at, stop)
            if words:
                if not begin:
                    first = line
                some = [w for w in words if w in idf]
                if some:
                    known.update(some)
                    left = self.price * (len(words) - len(some))
                    if RUN * sum(map(idf.__getitem__, some)) ** 2 >= left and RUN * self.inside(Counter(some)) >= left:
                        seeds.append(len(begin))
                others += len(words) - len(some)
                begin.append(at)
                end.append(stop)
            if begin and (not words or stop == len(raw)):
                whole = self.may_reach(self.inside(known), others)
                if seeds or whole:
                    yield from ((first + a, n, v) for a, n, v in self.runs(raw, begin, end, seeds, whole))
                begin, end, seeds, known, others = array("q"), array("q"), [], Counter(), 0
            at, line = stop + 1, line + 1

    def grown(self, raw: bytes, best: tuple[float, str, int, int]) -> tuple[float, str, int, int]:
        """The best run carried on line by line, down or up within its block, to wherever the cosine is highest within RUN further lines, as long as it rises."""
        lines = raw.split(b"\n")
        _, _, at, n = best
        own = Counter(w for x in lines[at : at + n] for w in WORD.findall(x))
        rises = True
        while rises:
            rises = False
            for step in (1, -1):
                v, k = own.copy(), at + n if step == 1 else at - 1
                for more in range(1, RUN + 1):
                    words = WORD.findall(lines[k]) if 0 <= k < len(lines) else []
                    if not words:
                        break
                    v.update(words)
                    s, name = self.score(v)
                    if s > best[0] + 1e-12:
                        best, rises = (s, name, at if step == 1 else at - more, n + more), True
                        own = v.copy()
                    k += step
                at, n = best[2:]
        return best

    def scan(self, raw: bytes, whole: bool) -> tuple[str | None, float | None, int | None, int | None]:
        """(licence, cosine, first line from 0, lines; -1 for the whole text) or nothing."""
        raw = raw.lower()
        best: tuple[float, str, int, int] = (0.0, "", 0, 0)
        run = best
        for a, n, v in self.candidates(raw):
            s, name = self.score(v)
            if s > best[0] + 1e-12:
                best = (s, name, a, n)
            if n <= RUN and s > run[0] + 1e-12:
                run = (s, name, a, n)
        if run[0] and (more := self.grown(raw, run))[0] > best[0] + 1e-12:
            best = more
        if whole:
            s, name = self.score(Counter(WORD.findall(raw)))
            if s > best[0] + 1e-12:
                best = (s, name, -1, -1)
        return (best[1], best[0], *best[2:]) if best[0] >= THRESHOLD else (None, None, None, None)


def scan(files: DataFrame) -> DataFrame:
    """files (id, path, text) -> id, path, own, cosine, line, lines."""
    idf = weights(files)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(idf)
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            found = [scanner.scan(data[a:b].tobytes(), bool(w)) for a, b, w in zip(offsets[:-1], offsets[1:], batch.column("is_file").to_pylist(), strict=True)]
            own, cosine, line, lines = zip(*found, strict=True) if found else ((), (), (), ())
            columns = [batch.column("id"), batch.column("path"), pa.array(own, pa.string()), pa.array(cosine, pa.float64()), pa.array(line, pa.int32()), pa.array(lines, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "path", "own", "cosine", "line", "lines"])

    of = files.select(F.col("id").cast("long").alias("id"), "path", "text", F.coalesce(F.rlike("path", F.lit(FILE_NAME)), F.lit(False)).alias("is_file"))
    return of.mapInArrow(rows, "id long, path string, own string, cosine double, line int, lines int")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(?:(.*)/)?[^/]*$", 1)


def above(d: Column) -> Column:
    """A directory and all above it, the root '' last."""
    parts = F.when(d == "", F.array().cast("array<string>")).otherwise(F.split(d, "/"))
    return F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def inherit(found: DataFrame, is_file: Column) -> DataFrame:
    """found (id, path, own, ...) -> with license (own, else the nearest licence file's) and license_from ('own', a directory or null)."""
    found = found.withColumn("_dir", directory(F.col("path")))
    held = found.where(is_file & F.col("own").isNotNull()).groupBy(F.col("_dir").alias("_at")).agg(F.min_by("own", "path").alias("_own"))
    up = found.where("_dir is not null").select("_dir").distinct().select("_dir", F.posexplode(above(F.col("_dir"))).alias("_far", "_at"))
    near = up.join(held, "_at").groupBy(F.col("_dir").alias("_d")).agg(F.min(F.struct("_far", "_own", "_at")).alias("_near"))
    out = found.join(near, F.col("_dir") == F.col("_d"), "left")
    return out.withColumns({"license": F.coalesce("own", "_near._own"), "license_from": F.when(F.col("own").isNotNull(), "own").otherwise(F.col("_near._at"))}).drop("_dir", "_d", "_near")


def licenses(files: DataFrame) -> DataFrame:
    """files (id, path, text) -> id, path, own, cosine, line, lines, license, license_from."""
    return inherit(cut(scan(files)), F.coalesce(F.rlike("path", F.lit(FILE_NAME)), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    """Documents as files source/k/doc_id.txt, k a hundred ids; one with a line that grants a licence is a licence file of its directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    states = F.rlike("text", F.lit(r"(?mi)^(this work is )?(licensed|released) under "))
    name = F.when(states, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 100), name)
    return licenses(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")
