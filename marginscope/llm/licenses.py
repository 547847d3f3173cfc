"""Licence texts and notices in documents, by the Dice coefficient of word bigrams.

A text is normalised (lower case, words only) and cut into its lines, its
paragraphs (runs of lines that are not blank) and itself. Each such unit is
compared with the licence templates: twice the number of common bigrams (as
multisets) over the sum of both numbers. A coefficient of t needs bigram counts
within a factor of t / (2 - t) of each other, so templates of other sizes are
pruned, and units that fit no template's size are not looked at; an inverted
index from bigram to templates counts the common ones of the rest.

Licences do not keep to such units: their paragraphs stand inside longer texts, notices
inside longer lines or beside code. So windows of words, across lines and
paragraphs, are compared too: each that begins and ends with a bigram of a template and holds one of
those that the fewest licences have. Of overlapping matches the one with the largest gain
stays, the common bigrams above those that a coefficient of t needs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Least coefficient of a match.
DICE = 0.8

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. ")
_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
          "this software without specific prior written permission. ")
_DISCLAIMER = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
               "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
               "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
               "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
               "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
               "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gnu(kind: str, version: str) -> str:
    name = f"GNU {kind}General Public License"
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
            f"Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope "
            "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
            f"PURPOSE. See the {name} for more details.")


#: Licences and the notices that stand for them, (licence, text).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
            "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
            "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
            "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
                   "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
                "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                     "and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-rights-reserved", "All rights reserved."),
    # the BSD disclaimer with the conditions before it, and the third condition
    ("BSD-2-Clause", _BSD + _DISCLAIMER),
    ("BSD-3-Clause", _BSD + _THIRD),
    ("BSD-3-Clause", _BSD + _THIRD + _DISCLAIMER),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
            "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
            "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
            "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
            "THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    # notices of the licences whose words are nearly those of the GPL, version 3
    ("GPL-2.0", _gnu("", "2")),
    ("LGPL-2.1", _gnu("Lesser ", "2.1")),
    ("LGPL-3.0", _gnu("Lesser ", "3")),
    ("AGPL-3.0", _gnu("Affero ", "3")),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    # full texts: paragraphs that only they hold
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-3.0", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By "
                "contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to "
                "make sure it remains free software for all its users."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this "
                   "document."),
]

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_BLANK = re.compile(r"\n[^\S\n]*\n")
MATCHES = "array<struct<license:string,template:int,line:int,dice:double,unit:string>>"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(found: list[str]) -> list[tuple[str, str]]:
    return list(zip(found, found[1:]))


def dice(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> float:
    total = len(a) + len(b)
    return 2 * sum((Counter(a) & Counter(b)).values()) / total if total else 0.0


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, least: float = DICE):
        self.least = least
        self.names = [n for n, _ in templates]
        grams = [bigrams(words(t)) for _, t in templates]
        self.sizes = [len(g) for g in grams]
        self.by_size = sorted((len(g), k) for k, g in enumerate(grams) if g)
        self.index: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        for k, g in enumerate(grams):
            for gram, n in Counter(g).items():
                self.index[gram].append((k, n))
        # bigrams of each template, and those of them that the fewest licences hold
        self.counts = [Counter(g) for g in grams]
        self.keys: dict[tuple[str, str], list[int]] = defaultdict(list)
        self.key_of: list[frozenset[tuple[str, str]]] = []
        holders = {gram: len({self.names[k] for k, _ in having}) for gram, having in self.index.items()}
        for k, g in enumerate(grams):
            fewest = min((holders[gram] for gram in g), default=0)
            self.key_of.append(frozenset(gram for gram in g if holders[gram] == fewest))
            for gram in self.key_of[k]:
                self.keys[gram].append(k)
        # units whose number of bigrams fits no template
        self.fits = {n for size, _ in self.by_size for n in range(int(size * least / (2 - least)), int(size * (2 - least) / least) + 2)}

    def best(self, found: list[str]) -> tuple[float, int] | None:
        """(coefficient, template) of the most similar template if it is similar enough; of equal ones the first."""
        n = len(found) - 1
        if n not in self.fits:
            return None
        ratio = self.least / (2 - self.least)
        a = bisect_left(self.by_size, (n * ratio - 1e-9, -1))
        b = bisect_right(self.by_size, (n / ratio + 1e-9, len(self.names)))
        fitting = {k for _, k in self.by_size[a:b]}
        common_grams: dict[int, int] = defaultdict(int)
        for gram, count in Counter(bigrams(found)).items():
            for k, have in self.index.get(gram, ()):
                if k in fitting:
                    common_grams[k] += min(count, have)
        scored = [(2 * c / (n + self.sizes[k]), -k) for k, c in common_grams.items()]
        top = max(scored, default=(0.0, 0))
        return (top[0], -top[1]) if top[0] >= self.least else None

    def scan(self, text: str | None) -> list[tuple[str, int, int, float, str]]:
        """(licence, template, first line, coefficient, unit) of each unit that matches; the most similar unit where they overlap."""
        if not text:
            return []
        lines = text.split("\n")
        hits = []
        per_line = []
        for at, line in enumerate(lines):
            found = words(line)
            per_line.append(found)
            hit = self.best(found)
            if hit:
                hits.append((hit[0], at, at + 1, hit[1], "line"))
        # paragraphs of more than one line, and the whole text
        start = None
        for at in range(len(lines) + 1):
            if at < len(lines) and lines[at].strip():
                start = at if start is None else start
            elif start is not None:
                if at - start > 1:
                    hits += self._joined(per_line, start, at, "paragraph")
                start = None
        if len(lines) > 1 and not all(x.strip() for x in lines):
            hits += self._joined(per_line, 0, len(lines), "text")
        # in words: a unit has those of its lines
        begin = [0]
        for found in per_line:
            begin.append(begin[-1] + len(found))
        hits = [(self._gain(d, begin[b] - begin[a] - 1, t), d, begin[a], begin[b], t, a, unit) for d, a, b, t, unit in hits]
        flat = [w for found in per_line for w in found]
        lines_of = {at: self.names[t] for _, _, _, _, t, at, unit in hits if unit == "line"}
        for gain, d, a, b, t in self._windows(flat):
            at = bisect_right(begin, a) - 1
            # what a whole line already says is not said again by a part of it
            if b > begin[at + 1] or lines_of.get(at) != self.names[t]:
                hits.append((gain, d, a, b, t, at, "window"))
        # the largest gain first, whole units before windows; one that overlaps a better one is left out
        kept: list[tuple] = []
        starts: list[int] = []
        for hit in sorted(hits, key=lambda h: (-round(h[0], 9), h[6] == "window", h[2], h[3], h[4])):
            at = bisect_left(starts, hit[3])
            if at == 0 or kept[at - 1][3] <= hit[2]:
                starts.insert(at, hit[2])
                kept.insert(at, hit)
        return [(self.names[t], t, at, d, unit) for _, d, _, _, t, at, unit in kept]

    def _gain(self, d: float, n: int, t: int) -> float:
        """Common bigrams above those that a match of this size needs."""
        return (d - self.least) * (n + self.sizes[t]) / 2

    def _windows(self, found: list[str]) -> list[tuple[float, float, int, int, int]]:
        """(gain, coefficient, first word, word after the last, template) of matching word windows; those of one template do not overlap."""
        grams = bigrams(found)
        keys = self.keys
        seeds = [i for i, gram in enumerate(grams) if gram in keys]
        near: dict[int, list[list[int]]] = {}
        for i in seeds:
            for t in keys[grams[i]]:
                reach = int(self.sizes[t] * (2 - self.least) / self.least)
                spans = near.setdefault(t, [])
                if spans and i - reach <= spans[-1][1]:
                    spans[-1][1] = i + reach
                else:
                    spans.append([max(0, i - reach), i + reach])
        out = []
        for t, spans in near.items():
            counts = self.counts[t]
            for a, b in spans:
                places = [i for i in range(a, min(b, len(grams))) if grams[i] in counts]
                out += self._runs(grams, places, t)
        return out

    def _runs(self, grams: list[tuple[str, str]], places: list[int], t: int) -> list[tuple[float, float, int, int, int]]:
        """The windows of one template among the places where its bigrams stand."""
        size, least, counts, own = self.sizes[t], self.least, self.counts[t], self.key_of[t]
        longest = int(size * (2 - least) / least + 1e-9)
        # the least number of common bigrams of any match
        need = max(1, math.ceil(size * least / (2 - least) - 1e-9))

        def best_end(k: int, limit: int) -> tuple | None:
            """The best window that begins at the k-th place and ends before ``limit``."""
            first, best = places[k], None
            if k + need > len(places) or places[k + need - 1] - first >= longest or places[k + need - 1] >= limit:
                return None
            left, common_grams, keyed = {}, 0, False
            for at in places[k:]:
                if at - first >= longest or at >= limit:
                    break
                gram = grams[at]
                have = left.get(gram, counts[gram])
                keyed = keyed or gram in own
                if have:
                    left[gram] = have - 1
                    common_grams += 1
                    n = at - first + 1
                    d = 2 * common_grams / (n + size)
                    if keyed and d >= least and (best is None or self._gain(d, n, t) > best[0] + 1e-9):
                        best = (self._gain(d, n, t), d, first, at + 2, t)
            return best

        chosen: list[tuple] = []
        begun: list[int] = []
        todo = range(len(places))
        while todo:
            # starts outside of what is chosen, each with its best window before the next chosen one
            some = []
            for k in todo:
                at = bisect_right(begun, places[k])
                if at and chosen[at - 1][3] - 1 > places[k]:
                    continue
                hit = best_end(k, begun[at] if at < len(begun) else len(grams))
                if hit:
                    some.append((hit, k))
            todo = []
            for hit, k in sorted(some, key=lambda x: (-round(x[0][0], 9), x[0][2])):
                at = bisect_right(begun, hit[2])
                if (at and chosen[at - 1][3] - 1 > hit[2]) or (at < len(begun) and begun[at] <= hit[3] - 2):
                    todo.append(k)
                else:
                    begun.insert(at, hit[2])
                    chosen.insert(at, hit)
            todo.sort()
        return chosen

    def _joined(self, per_line: list[list[str]], a: int, b: int, unit: str) -> list[tuple]:
        size = sum(map(len, per_line[a:b])) - 1
        if size not in self.fits:
            return []
        hit = self.best([w for ws in per_line[a:b] for w in ws])
        return [(hit[0], a, b, hit[1], unit)] if hit else []


def scanner(templates: list[tuple[str, str]] = TEMPLATES, least: float = DICE):
    """Column function: text -> its licence matches."""

    @F.pandas_udf(MATCHES)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scanner(templates, least)
        names = ("license", "template", "line", "dice", "unit")
        for batch in batches:
            yield pd.Series([[dict(zip(names, m)) for m in s.scan(t)] for t in batch], dtype=object)

    return scan


def matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = DICE, text_col: str = "text") -> Column:
    common.bound_batches(docs.sparkSession)
    return scanner(templates, least)(F.col(text_col))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, license, template, dice, unit): one row for each unit of a document that matches a template.

    Null and empty texts match nothing; a template needs two words. Of equally
    similar templates the first of the list counts. Repeated rows give repeated
    results; an empty table gives none; other columns are not looked at. ``line`` is
    the first line of a match; a window's is the one in which it begins.
    """
    base = docs.select(F.col(id_col).alias("_id"), matches(docs, templates, least, text_col).alias("_m")).where(F.size("_m") > 0)
    return base.select("_id", F.explode("_m").alias("m")).select(
        F.col("_id").alias(id_col), "m.line", "m.license", "m.template", F.round("m.dice", 9).alias("dice"), "m.unit"
    )
