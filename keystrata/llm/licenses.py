"""Licence scans: Dice coefficient over word bigrams against licence templates.

Units of a text are the whole of it, its paragraphs (parted by empty lines), its
lines, and for each template every window of as many words as the template has
that begins with a bigram of the template: so a notice is found within a line, and
a licence that stands twice. A unit and a template are compared by
2|A n B| / (|A| + |B|) over their sets of bigrams of normalised words. A template
of b bigrams can reach the threshold t only with units of t/(2-t) b to (2-t)/t b
bigrams, which leaves few templates for a unit, and only those that share a
bigram with it are scored; windows are tried only for templates with so many
bigrams in the text.

Nulls, empty texts and units of one word match nothing. Ties go to the template
with the smaller name. Repeated rows give the same row each; extra columns are
ignored. Very long texts are read whole; a window slides by adding and dropping
a bigram. Empty tables give none. A line is empty that has only ASCII white space.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fields, map_texts, texts, with_results

WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: A line with anything but ASCII white space.
FULL = re.compile(r"[^\t\n\f\r ]")
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."""
#: Notices and short texts that name themselves; the SQL holds these. ``full_texts`` has the whole licences.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": f"{_BSD_TERMS}\n{_BSD_WARRANTY}",
    "bsd-3-clause": f"{_BSD_TERMS}\n{_BSD_THIRD}\n{_BSD_WARRANTY}",
    "bsd-style-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Licensed under the MIT License. See the LICENSE file in the project root for license information.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

Bigram = tuple[str, str]


def full_texts() -> dict[str, str]:
    """Whole licences by name, read by the driver from beside this file."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}


def sequence(text: str) -> list[Bigram]:
    w = WORD.findall(text.lower())
    return list(zip(w, w[1:]))


def bigrams(text: str) -> frozenset[Bigram]:
    return frozenset(sequence(text))


class Scanner:
    def __init__(self, templates: Mapping[str, str], threshold: float) -> None:
        self.threshold = threshold
        self.sets = {n: g for n, t in sorted(templates.items()) if (g := bigrams(t))}
        self.spans = {n: len(sequence(templates[n])) for n in self.sets}
        self.holders: dict[Bigram, tuple[str, ...]] = {}
        for n, g in self.sets.items():
            for x in g:
                self.holders[x] = (*self.holders.get(x, ()), n)
        self.keys = frozenset(self.holders)
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.bounds = {n: (low * len(g), high * len(g)) for n, g in self.sets.items()}
        self.most = max((b for _, b in self.bounds.values()), default=0)

    def scored(self, unit: frozenset[Bigram]) -> list[tuple[str, float]]:
        """Templates at the threshold or above, of those whose size fits and that share a bigram."""
        size = len(unit)
        if not size or size > self.most:
            return []
        common = unit & self.keys
        out = []
        for n in sorted({h for x in common for h in self.holders[x]}):
            low, high = self.bounds[n]
            if low <= size <= high:
                dice = 2 * len(common & self.sets[n]) / (size + len(self.sets[n]))
                if dice >= self.threshold:
                    out.append((n, dice))
        return out

    def scan(self, text: str) -> dict[str, float]:
        """Best score of each template that a unit of the text reaches the threshold with."""
        best: dict[str, float] = {}

        def note(found: list[tuple[str, float]]) -> None:
            for n, d in found:
                best[n] = max(best.get(n, 0.0), d)

        lines = text.split("\n")
        grams = [bigrams(x) for x in lines]
        starts, part = [], []
        for i, x in enumerate(lines):
            if FULL.search(x):
                part.append(i)
            elif part:
                starts.append(part)
                part = []
        if part:
            starts.append(part)
        for p in starts:
            for i in p:
                note(self.scored(grams[i]))
            if len(p) > 1:
                note(self.scored(self._joined(lines, p[0], p[-1])))
        if len(starts) > 1:
            note(self.scored(self._joined(lines, 0, len(lines) - 1)))
        if any(len(g) > 1 and not g.isdisjoint(self.keys) for g in grams) or len(lines) > 1:
            note(self.windows(sequence(text)))
        return best

    def windows(self, grams: list[Bigram]) -> list[tuple[str, float]]:
        """Best score of each template over the windows of its length that begin with a bigram of it."""
        holders: dict[str, list[int]] = {}
        for i, g in enumerate(grams):
            for n in self.holders.get(g, ()):
                holders.setdefault(n, []).append(i)
        out = []
        for n, at in holders.items():
            own, span = self.sets[n], self.spans[n]
            least = self.bounds[n][0]  # bigrams in common that the threshold needs at least
            if len(at) < least:
                continue
            best = 0.0
            inside: Counter = Counter()
            shared = done = begin = 0
            for k, i in enumerate(at):
                # As many of the template's bigrams lie from here on within the window.
                if bisect.bisect_left(at, i + span, k) - k < least:
                    continue
                if i > done or not inside:
                    inside.clear()
                    shared, begin, done = 0, i, i
                while begin < i:
                    g = grams[begin]
                    inside[g] -= 1
                    if not inside[g]:
                        del inside[g]
                        shared -= g in own
                    begin += 1
                while done < min(i + span, len(grams)):
                    g = grams[done]
                    if not inside[g]:
                        shared += g in own
                    inside[g] += 1
                    done += 1
                best = max(best, 2 * shared / (len(inside) + len(own)))
            if best >= self.threshold:
                out.append((n, best))
        return out

    def _joined(self, lines: list[str], a: int, z: int) -> frozenset[Bigram]:
        return bigrams("\n".join(lines[a : z + 1]))


def license_scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: best licence and its Dice coefficient (null without one), all licences found, their number."""
    scanner = Scanner(templates, threshold)
    out = with_results(docs, id_col, fields(license=T.StringType(), dice=T.DoubleType(), licenses=T.StringType(), n_licenses=T.LongType()))

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [scanner.scan(x.decode("utf-8", "replace")) for x in texts(b.column(1))]
            top = [min(f.items(), key=lambda x: (-x[1], x[0])) if f else (None, None) for f in found]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([t[0] for t in top], pa.string()), pa.array([t[1] for t in top], pa.float64()), pa.array([",".join(sorted(f)) for f in found], pa.string()), pa.array(map(len, found), pa.int64(), size=len(found))], names=out.names)

        return run

    return map_texts(docs.select(id_col, text_col), text_col, out, make)


def _oracle(threshold: float = 0.85) -> str:
    """DuckDB SQL of the registered query: every unit against every template that its size allows."""
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    words = r"regexp_extract_all(lower({}), '[a-z0-9]+(?:\.[0-9]+)*')"
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    return f"""
WITH t AS (SELECT name, {grams.format('w')} AS g FROM (SELECT name, {words.format('body')} AS w FROM (VALUES {quoted}) v(name, body))),
l AS (SELECT doc_id, i, line, regexp_matches(line, '\\S') AS full_, {words.format('line')} AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
g AS (SELECT *, {grams.format('w')} AS g, sum(CASE WHEN full_ THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l),
p AS (SELECT doc_id, p, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n FROM g WHERE full_ GROUP BY doc_id, p),
x AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
y AS (SELECT doc_id, w, i, w[i] || ' ' || w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM x)),
q AS (SELECT name, len(w) AS m, g, unnest(g) AS b FROM (SELECT name, {words.format('body')} AS w, {grams.format(words.format('body'))} AS g FROM (VALUES {quoted}) v(name, body))),
a AS (SELECT y.doc_id, y.i, y.w, q.name, q.m, q.g, count(*) OVER (PARTITION BY y.doc_id, q.name ORDER BY y.i RANGE BETWEEN CURRENT ROW AND q.m - 2 FOLLOWING) AS hits FROM y JOIN q USING (b)),
z AS (SELECT doc_id, name, g AS tg, {grams.format('v')} AS g FROM (SELECT doc_id, name, g, w[i:i + m - 1] AS v FROM a WHERE hits >= {low!r} * len(g))),
u AS (SELECT doc_id, NULL AS name, line AS body FROM g WHERE full_
  UNION ALL SELECT doc_id, NULL, body FROM p WHERE n > 1
  UNION ALL SELECT doc_id, NULL, text FROM documents WHERE doc_id IN (SELECT doc_id FROM p GROUP BY doc_id HAVING count(*) > 1)),
s AS (SELECT doc_id, name, {grams.format('w')} AS g FROM (SELECT doc_id, name, {words.format('body')} AS w FROM u)),
d AS (SELECT doc_id, name, max(dice) AS dice FROM (SELECT s.doc_id, t.name, max((2 * len(list_intersect(s.g, t.g)))::DOUBLE / (len(s.g) + len(t.g))::DOUBLE) AS dice FROM s JOIN t ON len(s.g) BETWEEN {low!r} * len(t.g) AND {high!r} * len(t.g) WHERE len(s.g) > 0 GROUP BY ALL
  UNION ALL SELECT doc_id, name, max((2 * len(list_intersect(g, tg)))::DOUBLE / (len(g) + len(tg))::DOUBLE) FROM z GROUP BY ALL) GROUP BY ALL),
f AS (SELECT doc_id, arg_min(name, (-dice, name)) AS license, max(dice) AS dice, string_agg(name, ',' ORDER BY name) AS licenses, count(*)::BIGINT AS n FROM d WHERE dice >= {threshold!r} GROUP BY doc_id)
SELECT documents.doc_id, license, dice, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_licenses FROM documents LEFT JOIN f USING (doc_id)
"""


ORACLE = _oracle()
