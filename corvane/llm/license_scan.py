"""License scans by patience alignment of texts with license templates.

A template is found in a text where some stretch of the text, of at most ``spread`` times the template's length, covers
``LEAST_COVERAGE`` of the template's words. Coverage is measured by patience alignment: words that occur just once
in the stretch and once in the template are anchors, the longest increasing subsequence of the anchors is kept, and
the gaps between them are aligned in the same way. A gap without such words is aligned by the longest common
subsequence of all its words, which is the same search over every match instead of the unique ones.

Only stretches that hold enough of a template's words, as a multiset, are aligned: no alignment can cover more, so
nothing is lost. Coverage alone can't tell neighbouring licenses apart, whose notices differ in a word; where a scan is
``identified``, the words that name a license and its version must be matched too, side by side, and short forms word for
word. Templates are few and fixed (a bound is checked); the work is one pass over the texts, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, small_batches

LEAST_COVERAGE, SPREAD, MOST_TEMPLATES = 0.8, 1.5, 5000

#: Notices of public licenses, by SPDX identifier. A license may have several templates.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Phrases that must be matched without a gap, in each template of the license that has them.
IDENTITY: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License", "2.0"),
    "MIT": ("MIT",),
    "GPL-3.0": ("GNU General Public License", "version 3"),
    "GPL-2.0": ("GNU General Public License", "version 2"),
    "LGPL-3.0": ("GNU Lesser General Public License", "version 3"),
    "LGPL-2.1": ("GNU Lesser General Public License", "version 2.1"),
    "AGPL-3.0": ("GNU Affero General Public License", "version 3"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-4.0": ("Attribution 4.0",),
    "CC-BY-SA-4.0": ("Attribution-ShareAlike 4.0",),
    "MPL-2.0": ("Mozilla Public License", "2.0"),
}

#: Notices like the GPL's, of its neighbours.
NEIGHBOURS: tuple[tuple[str, str], ...] = tuple(
    (name, text.replace("GNU General", f"GNU {kind}General").replace("version 3", f"version {version}"))
    for name, kind, version in (("GPL-2.0", "", "2"), ("LGPL-3.0", "Lesser ", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("AGPL-3.0", "Affero ", "3"))
    for license, text in TEMPLATES
    if license == "GPL-3.0"
)

#: Names of licenses as they stand in one-line notices, found word for word only. No form may be part of a notice of another license.
SHORT_FORMS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Apache License 2.0"),
    ("GPL-3.0", "GNU General Public License version 3.0"),
    ("GPL-2.0", "GNU General Public License version 2.0"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3.0"),
    ("AGPL-3.0", "GNU Affero General Public License version 3.0"),
    ("LicenseRef-BSD", "Released under the BSD License"),
    ("LicenseRef-BSD", "Licensed under the BSD License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "Released under the ISC License"),
    ("ISC", "Licensed under the ISC License"),
    ("EPL-2.0", "Eclipse Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    *((f"CC-{kind}-4.0", f"CC {kind} 4.0") for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"),
)

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
FOUND = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
FOUND_DDL = "array<struct<license: string, coverage: double, matched: int, first_word: long, last_word: long>>"


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, joined over single dots and hyphens; null has none."""
    return _WORD.findall((text or "").lower())


def longest_increasing(values: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[at], ends[at] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Patience alignment: the pairs (place in a, place in b) of equal items that are matched, in order."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        only = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1 and in_a.get(b[j]) == 1}
        if only:
            pairs = [(i, only[a[i]]) for i in range(a0, a1) if a[i] in only]
        else:  # every match, of one place in a the later ones in b first: a chain then takes one of them at most
            places = defaultdict(list)
            for j in range(b1 - 1, b0 - 1, -1):
                places[b[j]].append(j)
            pairs = [(i, j) for i in range(a0, a1) for j in places.get(a[i], ())]
        chain = [pairs[k] for k in longest_increasing([j for _, j in pairs])]
        out += chain
        if only:
            edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Templates:
    """Templates with their words numbered; 0 is any other word."""

    def __init__(self, templates: Sequence[tuple[str, str]], least: float = LEAST_COVERAGE, identified: bool = False, spread: float = SPREAD):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        cut = [(name, words(text)) for name, text in templates]
        if any(not w for _, w in cut):
            raise ValueError("a template has no words")
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in cut for w in ws}), 1)}
        self.names = [name for name, _ in cut]
        self.words = [[self.vocabulary[w] for w in ws] for _, ws in cut]
        self.counts = np.array([np.bincount(w, minlength=len(self.vocabulary) + 1) for w in self.words])
        self.need = [max(1, int(np.ceil(least * len(w) - 1e-9))) for w in self.words]
        self.stretch = [int(np.ceil(spread * len(w))) for w in self.words]
        self.marks: list[list[range]] = [[] for _ in cut]  # places of the phrases that must be matched without a gap
        for k, ((name, ws), form) in enumerate(zip(cut, templates)):
            if identified and form in SHORT_FORMS:
                self.marks[k] = [range(len(ws))]
            elif identified:
                phrases = [words(x) for x in IDENTITY.get(name, ())]
                first = [next((i for i in range(len(ws)) if ws[i : i + len(x)] == x), None) for x in phrases]
                self.marks[k] = [range(i, i + len(x)) for i, x in zip(first, phrases) if i is not None]

    def identifies(self, k: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether the pairs (place in the text, place in template k) match all that names the license."""
        if not self.marks[k]:
            return True
        at = {j: i for i, j in pairs}
        return all(j in at and at[j] - j == at.get(mark[0], -1) - mark[0] for mark in self.marks[k] for j in mark)

    def starts(self, k: int, ids: np.ndarray) -> list[int]:
        """Places of template k's words in ids from which a stretch holds enough of the template's words as a multiset."""
        n, length = len(ids), self.stretch[k]
        hits = np.concatenate([[0], np.cumsum(self.counts[k][ids] > 0)])
        ends = np.minimum(np.arange(n) + length, n)
        likely = np.flatnonzero((hits[ends] - hits[:-1] >= self.need[k]) & (self.counts[k][ids] > 0))
        out, held, common, lo, hi = [], Counter(), 0, 0, 0
        limit = self.counts[k].tolist()
        for at in likely.tolist():
            if at >= hi:  # a new run of stretches
                held.clear()
                common, lo, hi = 0, at, at
            end = min(at + length, n)
            for w in ids[hi:end].tolist():
                held[w] += 1
                common += held[w] <= limit[w]
            for w in ids[lo:at].tolist():
                common -= held[w] <= limit[w]
                held[w] -= 1
            lo, hi = at, end
            if common >= self.need[k]:
                out.append(at)
        return out

    def find(self, text: str | None) -> list[dict]:
        """The licenses found, each by its best stretch: highest coverage, then most words, then first; best license first."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words(text)], np.int64)
        if not len(ids):
            return []
        own = np.bincount(ids, minlength=len(self.vocabulary) + 1)
        own[0] = 0
        best: dict[str, tuple] = {}
        for k in np.flatnonzero(np.minimum(self.counts, own).sum(axis=1) >= self.need).tolist():
            template, done = self.words[k], -1
            for at in self.starts(k, ids):
                if at <= done:
                    continue
                pairs = align(ids[at : at + self.stretch[k]].tolist(), template)
                if len(pairs) >= self.need[k] and self.identifies(k, pairs):
                    first, last = at + pairs[0][0], at + pairs[-1][0]
                    found = (-round(len(pairs) / len(template), 6), -len(pairs), first, last)
                    best[self.names[k]] = min(best.get(self.names[k], found), found)
                    if len(pairs) == len(template):
                        done = last  # a whole template; nothing inside it is a better start
        ranked = sorted(best.items(), key=lambda x: (x[1][:2], x[0]))
        return [{"license": name, "coverage": -c, "matched": -m, "first_word": first, "last_word": last} for name, (c, m, first, last) in ranked]


_KNOWN: dict[tuple, Templates] = {}


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text", identified: bool = False, spread: float = SPREAD) -> DataFrame:
    """(id, found) per row of docs: found lists the licenses of its text, best coverage first, with the places of the first and last matched word. Where ``identified``, licenses whose name or version isn't matched are left out.

    Null, empty and wordless texts have none; equal coverages are ordered by matched words, then name; repeated rows and
    null ids stay as they are; an empty table gives no rows; other columns are ignored.
    """
    require(docs, (id_col, text_col))
    small_batches(docs.sparkSession)
    key = (tuple(templates), least, identified, spread)
    Templates(*key)  # refused here rather than on the executors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _KNOWN:
            _KNOWN[key] = Templates(*key)
        known = _KNOWN[key]
        for batch in batches:
            found = [known.find(text.as_py()) for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, FOUND)], names=["id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, found {FOUND_DDL}")


def best_license(docs: DataFrame) -> DataFrame:
    """doc_id, license (null if none is identified), coverage, n_matched, first_word, last_word, n_licenses of every document, and licenses: all that were found, as a list."""
    top = F.get("found", F.lit(0))
    return scan(docs, (*TEMPLATES, *NEIGHBOURS, *SHORT_FORMS), identified=True).select(
        F.col("id").alias("doc_id"),
        top["license"].alias("license"),
        F.coalesce(top["coverage"], F.lit(0.0)).alias("coverage"),
        F.coalesce(top["matched"], F.lit(0)).alias("n_matched"),
        top["first_word"].alias("first_word"),
        top["last_word"].alias("last_word"),
        F.size("found").alias("n_licenses"),
        F.col("found").alias("licenses"),
    )
