"""License scans by patience alignment.

A text's words (lower case, without outer punctuation) are aligned with a license template: words that occur once in both are
anchors, the longest increasing subsequence of their places fixes the frame, and the gaps between anchors are aligned in the same
way again, down to runs of equal words at a gap's two ends. Coverage is the share of the template's words that are aligned.

A template needs at least the asked coverage, so only so many of its words may be missing, and a stretch can only match if it holds all
of the template's different words but that many; a sliding window finds such stretches, wherever they stand and however often, before any alignment.
Windows begin at somewhat more than the template's length and double until they hold the whole text, so that any number of words may stand between a
license's own. What a wider window finds replaces a narrower find only if it aligns more words and meets that find alone: copies side by side stay apart.

Defined cases: null and blank texts have no license; words put into a license, however many, lower no coverage (start_word and end_word tell how far it is
spread); of templates that cover the same stretch, the one with more aligned words stands, then
the one that is covered more, then the first by name; a text of any length is scanned whole; repeated rows are scanned each; no rows give none; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafmill.llm import common

MIN_COVERAGE = 0.8
#: Stretches of so many times the template's words are looked at first; then of twice as many each time, up to the whole text.
SLACK = 1.5

# Texts of public licenses and their usual notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOUND = "doc_id long, n_licenses long, license string, coverage double, start_word long, end_word long, licenses array<struct<license: string, coverage: double, start_word: bigint, end_word: bigint>>"


def words_of(text: str | None) -> list[str]:
    """The words of a text, in lower case and without outer punctuation; a word of punctuation alone is empty but keeps its place."""
    return [w.strip(".,;:!?()[]{}<>\"'`*#$%&|/\\-_=+~") for w in WORD.findall((text or "").lower())]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first members, whose second members rise (patience sorting)."""
    tops: list[int] = []
    at_top: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        before.append(at_top[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            at_top.append(i)
        else:
            tops[pile], at_top[pile] = b, i
    out, i = [], at_top[-1] if at_top else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, rising in both. A worklist stands in for recursion, so depth has no bound."""
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
        n_a, n_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        in_b = {w: j for j, w in enumerate(b[b0:b1], b0) if n_b[w] == 1}
        anchors = rising([(i, in_b[w]) for i, w in enumerate(a[a0:a1], a0) if n_a[w] == 1 and w in in_b])
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(ends, ends[1:], strict=False) if anchors]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, min_coverage: float):
        self.name, self.words = name, [w for w in words_of(text) if w]
        self.kinds = frozenset(self.words)
        self.need = len(self.kinds) - (len(self.words) - math.ceil(min_coverage * len(self.words)))


class Scanner:
    def __init__(self, templates: dict[str, str], min_coverage: float):
        self.templates = [Template(k, t, min_coverage) for k, t in sorted(templates.items())]
        self.min_coverage = min_coverage
        self.kinds = frozenset().union(*(t.kinds for t in self.templates))

    def stretches(self, t: Template, places: list[tuple[int, str]], most: int) -> Iterator[tuple[int, int]]:
        """Stretches of the text that hold enough of the template's different words within `most` words. A window is kept as short as its words allow; one
        that begins behind the stretch at hand opens the next stretch, so copies side by side are told apart."""
        held: Counter[str] = Counter()
        low, best, done, run = 0, 0, 0, None
        for at, word in places:
            held[word] += 1
            while at - places[low][0] >= most or held[places[low][1]] > 1:
                held[places[low][1]] -= 1
                if not held[places[low][1]]:
                    del held[places[low][1]]
                low += 1
            first = places[low][0]
            if len(held) < t.need:
                continue
            if run is None or first >= run[1]:
                if run:
                    yield run[0], min(first, run[1] + most)
                    done = run[1]
                run, best = (max(done, at + 1 - most), at + 1), len(held)
            elif len(held) > best:
                run, best = (run[0], at + 1), len(held)
        if run:
            yield run[0], run[1] + most

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) of each stretch that a template covers, in order of place."""
        words = words_of(text)
        there = self.kinds.intersection(words)
        fits = [t for t in self.templates if len(t.kinds & there) >= t.need]
        if not fits:
            return []
        kept: list[tuple] = []
        places = {t.name: [(i, w) for i, w in enumerate(words) if w in t.kinds] for t in fits}
        widths = {t.name: int(SLACK * len(t.words)) + 2 for t in fits}
        tried: set[tuple[str, int, int]] = set()
        while fits:
            found = []
            for t in fits:
                for low, high in self.stretches(t, places[t.name], widths[t.name]):
                    at = (t.name, max(low, 0), min(high, len(words)))
                    if at not in tried and len(pairs := aligned(words[at[1] : at[2]], t.words)) >= self.min_coverage * len(t.words):
                        found.append((len(pairs), t.name, len(pairs) / len(t.words), at[1] + pairs[0][0], at[1] + pairs[-1][0] + 1))
                    tried.add(at)
            for f in sorted(found, key=lambda f: (-f[0], -f[2], f[4] - f[3], f[1], f[3])):
                met = [k for k in kept if f[4] > k[3] and f[3] < k[4]]
                if not met or len(met) == 1 and met[0] not in found and f[0] > met[0][0]:
                    kept = [k for k in kept if k not in met] + [f]
            fits = [t for t in fits if widths[t.name] < len(words)]
            widths = {t.name: 2 * widths[t.name] for t in fits}
        return [(name, round(share, 6), low, high) for _, name, share, low, high in sorted(kept, key=lambda f: f[3])]


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row a document: how many licenses, the best one, and all with their places in words."""
    scanner = Scanner(templates or TEMPLATES, min_coverage)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = scanner.scan(text)
                best = max(found, key=lambda f: (f[1], f[3] - f[2], -f[2]), default=(None, None, None, None))
                rows.append((None if pd.isna(doc_id) else int(doc_id), len(found), *best, [dict(zip(("license", "coverage", "start_word", "end_word"), f, strict=True)) for f in found]))
            out = pd.DataFrame(rows, columns=["doc_id", "n_licenses", "license", "coverage", "start_word", "end_word", "licenses"], dtype=object)
            yield out.astype({"doc_id": "Int64", "n_licenses": "Int64", "start_word": "Int64", "end_word": "Int64", "coverage": "Float64"})

    # ids as text: beside a null, pandas would round them to doubles
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(scan, FOUND)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.load(spark, sf_dir, "documents"))
