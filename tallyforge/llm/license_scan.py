"""License scans by patience alignment of each text with each license template.

Words are compared lower-cased, without punctuation. A text and a template are
anchored on words that occur once in both; the longest increasing subsequence of the
anchors' places is kept, and the gaps between neighbours are aligned the same way,
where more words are unique. A gap without anchors matches its common ends. Coverage is
the share of the template's words that are matched.

A text is aligned with a template only if it holds enough of its distinct words for
the least coverage that is reported: words absent from the text can't be matched, so
this bound drops no match. Texts are whole, of any length; the templates are few and
short, so a text's cost follows its length. All matches are reported with their places:
beside a template's best one, the text to its left and right is searched in windows.
Matches that lie in a longer one of another template (a notice in its license) are not.
Null or empty text has no license; an empty table gives no rows. Ties go to the longer
match, then to the earlier template. Rows that repeat are scanned each, texts of any
length whole; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Public licenses, whole where they are short, else the notice that files carry.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
}
COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
RESULT = "doc_id long, license string, coverage double, matched long, template_words long, first_word long, last_word long, start long, end long, n_matches long, matches string"


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back[i] = piles[pile - 1] if pile else -1
        tops[pile : pile + 1] = [v]
        piles[pile : pile + 1] = [i]
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text word, template word) places, increasing in both."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        theirs = Counter(template[c:d])
        ours: dict[str, int] = {}
        twice = set()
        for i in range(a, b):
            w = text[i]
            if w in theirs:
                if w in ours:
                    twice.add(w)
                ours[w] = i
        anchors = [(ours[w], j) for j, w in enumerate(template[c:d], c) if theirs[w] == 1 and w in ours and w not in twice]
        kept = [anchors[i] for i in increasing([x for x, _ in anchors])]
        if not kept:
            continue
        for (i, j), (k, m) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)], strict=True):
            if i + 1 < k and j + 1 < m:
                gaps.append((i + 1, k, j + 1, m))
        found += kept
    return sorted(found)


NOTHING: tuple = (None, 0.0, 0, 0, None, None, None, None, 0, "")


def scan_batches(templates: dict[str, str], least: float):
    names = [x.split()[0] for x in RESULT.split(", ")]
    sides = [(n, [w.lower() for w in WORD.findall(t)]) for n, t in templates.items()]
    sides = [(n, t, Counter(t)) for n, t in sides if t]
    needed = frozenset().union(*(c for _, _, c in sides)) if sides else frozenset()

    def best(text: str) -> tuple:
        here = needed.intersection(WORD.findall(text.lower()))
        able = [(n, t) for n, t, c in sides if sum(k for w, k in c.items() if w in here) >= least * len(t)]
        if not able:
            return NOTHING
        places = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in places]
        found = []
        for rank, (name, template) in enumerate(able):
            for pairs in every(words, template, least):
                first, last = pairs[0][0], pairs[-1][0]
                found.append((-len(pairs) / len(template), -len(pairs), rank, first, last, name, len(template)))
        if not found:
            return NOTHING
        share, matched, _, first, last, name, size = min(found)
        inside = lambda x: any(y[3] <= x[3] and x[4] <= y[4] and y[1] < x[1] for y in found)
        listed = sorted((places[x[3]][0], places[x[4]][1], x[5]) for x in found if not inside(x))
        return (name, -share, -matched, size, first, last, places[first][0], places[last][1], len(listed), ",".join(f"{n}:{a}:{b}" for a, b, n in listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.float64()] + [pa.int64()] * 7 + [pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                rows = [best(x or "") for x in part["text"].to_pylist()]
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([part["doc_id"], *[pa.array(x, k) for x, k in zip(columns, kinds[1:], strict=True)]], names=names)

    return run


def windows(words: list[str], template: list[str], width: int, step: int, least: float):
    """(start, words of the template held) of the windows that hold ``least`` of them or more."""
    wanted, held, total = Counter(template), Counter(), 0
    for i, w in enumerate(words):
        if w in wanted:
            held[w] += 1
            total += held[w] <= wanted[w]
        if i >= width and (gone := words[i - width]) in wanted:
            total -= held[gone] <= wanted[gone]
            held[gone] -= 1
        start = max(0, i - width + 1)
        if total >= least and (start % step == 0 or i == len(words) - 1):
            yield start, total


def regional(words: list[str], template: list[str], least: float = COVERAGE) -> list[tuple[int, int]]:
    """The best alignment of the template with the text as a whole or with one region of it.

    Words that are unique in a template can recur elsewhere in a long text, which
    leaves the whole without anchors. Regions are the places of the template's rarest
    word of the text, each spanning twice the template, and all windows of the template's
    length and of twice that which hold enough of its words to beat what is found.
    """
    best, n = align(words, template), len(template)
    own = set(template)
    counts = Counter(w for w in words if w in own)
    rare = min((w for w in own if counts[w]), key=lambda w: (counts[w], template.index(w)), default=None)
    if len(best) == n or rare is None:
        return best
    rarest = ((max(0, at - 2 * n), at + 2 * n, n) for at, w in enumerate(words) if w == rare)
    near = ((a, a + k * n, held) for k, step in ((1, 1), (2, max(1, n // 4))) for a, held in windows(words, template, k * n, step, least * n))
    for a, b, most in chain(rarest, near):
        if most > len(best):
            found = align(words[a:b], template)
            if len(found) > len(best):
                best = [(i + a, j) for i, j in found]
    return best


def every(words: list[str], template: list[str], least: float) -> list[list[tuple[int, int]]]:
    """The best alignment and all others that keep clear of it and of each other, from left to right."""
    best, n = regional(words, template, least), len(template)
    if len(best) < least * n:
        return []
    out = [best]
    for lo, hi in ((0, best[0][0]), (best[-1][0] + 1, len(words))):
        side, free = words[lo:hi], 0
        for a, _ in windows(side, template, 2 * n, max(1, n // 4), least * n):
            if a + n <= free:
                continue
            a = max(a, free)
            found = max(align(side[a : a + 2 * n], template), align(side[a : a + n], template), key=len)
            if len(found) >= least * n:
                out.append([(i + a + lo, j) for i, j in found])
                free = a + found[-1][0] + 1
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """One row per document: its best license, if any, and where, and all matches with their places."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(scan_batches(TEMPLATES if templates is None else templates, least), RESULT)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
