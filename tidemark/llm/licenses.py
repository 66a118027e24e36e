"""Licence scans: TF-IDF cosine to templates, and inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, id_back, id_text, written

#: Parts that several licences share (fixed texts).
NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
NO_WARRANTY_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
#: Notices as they stand in file headers, and texts of licence files (fixed texts; pass others as ``templates``).
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", MIT_GRANT, f"MIT License {MIT_GRANT} {NO_WARRANTY}"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", f"{BSD_CONDITIONS} {BSD_THIRD}", f"{BSD_CONDITIONS} {BSD_THIRD} {NO_WARRANTY_BSD}"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", BSD_CONDITIONS, f"{BSD_CONDITIONS} {NO_WARRANTY_BSD}"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "proprietary": ["All rights reserved."],
}
#: Templates of more words are licences that fill a file: they are compared with whole texts only, under idf weights of their own terms.
PASSAGE = 600
TOKEN = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Templates:
    """TF-IDF vectors of the templates; ``weights``: idf of their terms, ``rare``: that of every other term.

    ``anchors``: by term, its first places ``(before, length)`` in templates. A template's anchors are its heaviest terms, so many that a text
    without any of them has a cosine below ``least``: what comes near a template holds an anchor.
    """

    def __init__(self, templates: Mapping[str, list[str]], found: Mapping[str, int], total: int, least: float):
        self.rare, self.least = math.log(total + 1) + 1, least
        self.weights = {t: math.log((total + 1) / (found.get(t, 0) + 1)) + 1 for texts in templates.values() for x in texts for t in tokens(x)}
        self.vectors, self.anchors = [], {}
        for name, texts in templates.items():
            for x in texts:
                words = tokens(x)
                v = {t: n * self.weights[t] for t, n in Counter(words).items()}
                size = math.sqrt(sum(w * w for w in v.values()))
                v = {t: w / size for t, w in v.items()}
                self.vectors.append((name, v))
                share = 0.0
                for t in sorted(v, key=lambda t: (-v[t], t)):
                    if share > 1 - least * least + 1e-9:
                        break
                    share += v[t] * v[t]
                    self.anchors.setdefault(t, set()).add((words.index(t), len(words)))

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """The nearest template at a cosine of ``least`` or more; ties go to the first. Most texts share too little weight
        with all templates together to come near any of them, which ends the search."""
        least = self.least
        shared, other = {}, 0.0
        for t, n in Counter(words).items():
            if (w := self.weights.get(t)) is None:
                other += n * n
            else:
                shared[t] = n * w
        inside = sum(w * w for w in shared.values())
        if not inside or inside < least * least * (inside + other * self.rare**2):
            return None
        size, best = math.sqrt(inside + other * self.rare**2), (0.0, "")
        for name, v in self.vectors:
            score = sum(w * v[t] for t, w in shared.items() if t in v) / size
            if score > best[0] + 1e-12:
                best = (score, name)
        return best if best[0] >= least else None

    def header(self, words: list[str]) -> tuple[float, str] | None:
        """The best over the passages as long as a template that lie about one of its anchors as it does, wherever line ends are.

        One window a length slides over the text: dot products are running sums, as they are linear in the counts, and the square of the
        norm changes by a word that enters and one that leaves. So a text costs its words times the lengths, however many anchors it holds.
        """
        places: dict[int, set[int]] = {}
        for at, w in enumerate(words):
            for before, n in self.anchors.get(w, ()):
                places.setdefault(n, set()).add(max(0, at - before))
        if not places:
            return None
        ids: dict[str, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        weight = np.array([self.weights.get(w, self.rare) for w in ids])
        square = weight * weight
        upto = lambda x: np.concatenate(([0.0], np.cumsum(x)))
        mass = upto(square[code])
        dots = [upto((weight * np.array([v.get(w, 0.0) for w in ids]))[code]) for _, v in self.vectors]
        found = []
        for n, starts in sorted(places.items()):
            start = np.array(sorted(starts))
            end = np.minimum(start + n, len(words))
            best = np.max([d[end] - d[start] for d in dots], axis=0)
            some = best >= (self.least - 1e-9) * np.sqrt(mass[end] - mass[start])  # the norm is this much at least
            if some.any():
                start, end, best = start[some], end[some], best[some]
                score = best / np.sqrt(self.norms(code, square, start, end))
                found.append((start, np.full(len(start), n), score))
        if not found:
            return None
        start, length, score = (np.concatenate(x) for x in zip(*found, strict=True))
        if (top := score.max()) < self.least - 1e-9:
            return None
        first = min((s, n) for s, n, x in zip(start.tolist(), length.tolist(), score.tolist(), strict=True) if x >= top - 1e-9)
        return self.best(words[first[0] : sum(first)])

    @staticmethod
    def norms(code: np.ndarray, square: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The squares of the norms of windows in ascending order, by a window that slides."""
        count, now, out = [0] * len(square), 0.0, []
        codes, weights, a, b = code.tolist(), square.tolist(), int(start[0]), int(start[0])
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            if s >= b:  # nothing in common: anew, which also stops errors from adding up
                for i in range(a, b):
                    count[codes[i]] = 0
                a = b = s
                now = 0.0
            for i in range(b, e):
                c = codes[i]
                now += weights[c] * (2 * count[c] + 1)
                count[c] += 1
            for i in range(a, s):
                c = codes[i]
                count[c] -= 1
                now -= weights[c] * (2 * count[c] + 1)
            a, b = s, e
            out.append(now)
        return np.array(out)


def with_whole_texts(templates: Mapping[str, list[str]] = TEMPLATES) -> dict[str, list[str]]:
    """``templates`` and the whole texts of long licences that lie beside this module, each under the name of its file."""
    folder = resources.files(__package__) / "license_texts"
    texts = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    return {name: [*templates.get(name, []), *([texts[name]] if name in texts else [])] for name in [*templates, *sorted(set(texts) - set(templates))]}


def term_counts(docs: DataFrame, templates: Mapping[str, list[str]]) -> tuple[dict[str, int], int]:
    """In how many documents each term of the templates occurs, over all documents (one count for each term of the templates)."""
    terms = {t for texts in templates.values() for x in texts for t in tokens(x)}

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for x in frames:
            for text in x.text:
                n.update(terms.intersection(tokens(text or "")))
                n[""] += 1
        if n:
            yield pd.DataFrame({"term": list(n), "n": list(n.values())})

    found = {r.term: r.n for r in docs.select("text").mapInPandas(batches, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop("", 0)


def scan(docs: DataFrame, templates: Mapping[str, list[str]] | None = None, least: float = 0.7) -> DataFrame:
    """``doc_id, path, license, score, kind, licensed_by`` for each row of ``docs`` (``doc_id``, ``path``, ``text``).

    A file whose whole text comes near a template (cosine of ``least`` or more) is a licence file (kind ``file``) and licenses its
    directory; one with such a passage has a header (``header``). A file with neither takes the licence of the licence
    file in its own directory or else in the nearest one above (``inherited``), of several in one directory the nearest to its template,
    then the first by ``path``; ``licensed_by`` is that file's path. Others have nulls. Null texts are empty; a file without
    path inherits nothing. Rows that repeat are judged alike. ``templates``: by default :func:`with_whole_texts`.
    """
    templates = with_whole_texts() if templates is None else templates
    counts = term_counts(docs, templates)
    sized = lambda fits: {name: [x for x in texts if fits(len(tokens(x)))] for name, texts in templates.items()}
    short, filling = sized(lambda n: n <= PASSAGE), sized(lambda n: n > PASSAGE)
    model = docs.sparkSession.sparkContext.broadcast((Templates(short, *counts, least), Templates(filling, *counts, least)))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, long = model.value
        for x in frames:
            out = []
            for text in x.text:
                words = tokens(text or "")
                whole = max(filter(None, (t.best(words), long.best(words))), key=lambda b: b[0], default=None)
                found = whole or t.header(words)
                out.append((found[1], found[0], "file" if whole else "header") if found else (None, None, None))
            names, scores, kinds = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [])
            yield pd.DataFrame({"doc_id": x.doc_id.to_numpy(object), "path": x.path.to_numpy(object), "license": np.array(names, object), "score": np.array(scores, float), "kind": np.array(kinds, object)})

    own = id_back(id_text(docs, "path", "text").mapInPandas(batches, "doc_id string, path string, license string, score double, kind string"))
    own = written(own.withColumn("score", F.nanvl("score", F.lit(None))).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), "own")
    files = own.where("kind = 'file' and path is not null").groupBy("dir")
    files = files.agg(F.min(F.struct((-F.col("score")).alias("far"), F.col("path").alias("licensed_by"), F.col("license"))).alias("x")).select("dir", "x.licensed_by", "x.license")
    asking = own.where("kind is null and path is not null").groupBy("dir").agg(F.count("*").alias("n"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), i.alias("depth")))
    up = asking.select(F.col("dir").alias("below"), "n", F.explode(above).alias("a")).select("below", "n", "a.dir", "a.depth")
    near = up.join(files, "dir").groupBy("below", "n").agg(F.max_by(F.struct("licensed_by", "license"), "depth").alias("x"))
    near = written(near.select(F.col("below").alias("dir"), "n", F.col("x.licensed_by").alias("licensed_by"), F.col("x.license").alias("inherited")), "near")
    rows = own.where("kind is null and path is not null")
    got = attach(rows, near, "dir", "n").select("doc_id", "path", F.col("inherited").alias("license"), "score", F.lit("inherited").alias("kind"), "licensed_by")
    none = rows.join(near, "dir", "left_anti").select("doc_id", "path", "license", "score", "kind", F.lit(None).cast("string").alias("licensed_by"))
    rest = own.where("kind is not null or path is null").select("doc_id", "path", "license", "score", "kind", F.lit(None).cast("string").alias("licensed_by"))
    return rest.unionByName(got).unionByName(none)
