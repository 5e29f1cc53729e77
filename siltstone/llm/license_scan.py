"""Operator 3: license scan by patience alignment.

Texts and license templates are read as words without case and outer
punctuation.  A template and a stretch of text are aligned by anchoring on the
words that are unique in both, taking the longest increasing subsequence of the
anchors, and aligning the gaps between them in the same way (equal words at the
ends of a gap match first).  The coverage is the share of the template's words
that are matched; stretches with at least ``least_cover`` are reported.

Which stretches are aligned follows from the threshold: a stretch that covers
``least_cover`` of a template of n words must hold a word of any floor((1 -
least_cover) * n) + 1 places of the template, so only stretches around the
longest words of that many places are looked at.  Stretches reach half the
template's length beyond it, which allows for as many inserted words.  Where
stretches run into one another and too little of the whole is matched, a window
around each of these words is aligned on its own, so copies may follow each other.

One narrow pass over the rows: no shuffle, no skew, memory bounded by a batch.
Where similar templates match the same words, the better match counts (see
``_told_apart``); equally good ones are all reported, by place and name.
Null and empty texts match nothing; repeated rows give repeated results; words of any
length and texts of any length are fine (time grows with the text and the number of
copies in it); other columns, also of clashing names, are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_bytes, tidy

#: What the two-clause and the three-clause license have in common.
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Well-known license statements, notices and texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-opening": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "BSD-2-Clause": f"{_BSD_TERMS} {_BSD_WARRANTY}",
    "BSD-3-Clause": (
        f"{_BSD_TERMS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        f"derived from this software without specific prior written permission. {_BSD_WARRANTY}"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
}

_EDGE = re.compile(r"^\W+|\W+$")


def words_of(text: str) -> list[str]:
    return [w for w in (_EDGE.sub("", x).lower() for x in text.split()) if w]


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails, at, before = [], [], [0] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = at[k - 1] if k else -1
        tails[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out, waiting = [], [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if once_b[b[j]] == 1}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if once_a[a[i]] == 1 and a[i] in place]
        if not anchors:
            continue
        anchors = [anchors[k] for k in increasing([j for _, j in anchors])]
        out += anchors
        for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            waiting.append((i + 1, i2, j + 1, j2))
    return sorted(out)


class LicenseScanner:
    def __init__(self, templates: dict[str, str], least_cover: float, limit: int = 300_000):
        self.least_cover, self.limit = least_cover, limit
        self.templates = [(name, words_of(text)) for name, text in sorted(templates.items())]
        self.templates = [(name, words) for name, words in self.templates if words]
        #: word -> (template, place) of the words around which stretches are aligned
        self.keys: dict[str, list[tuple[int, int]]] = {}
        for t, (_, words) in enumerate(self.templates):
            need = len(words) - -int(-(least_cover * len(words)) // 1) + 1
            for place in sorted(range(len(words)), key=lambda p: (-len(words[p]), p))[:need]:
                self.keys.setdefault(words[place], []).append((t, place))
        self.stems = re.compile("|".join(sorted(map(re.escape, self.keys), key=len, reverse=True)) or r"(?!)")

    def scan(self, text: str) -> list[tuple]:
        """(license, coverage, matched, template words, first word, last word), by place."""
        if not self.stems.search(text.lower()):
            return []
        words = words_of(text)
        stretches: dict[int, list[tuple[int, int]]] = {}
        hits: dict[int, list[tuple[int, int]]] = {}
        for p, word in enumerate(words):
            for t, place in self.keys.get(word, ()):
                n = len(self.templates[t][1])
                slack = n // 2 + 4
                own = stretches.setdefault(t, [])
                hits.setdefault(t, []).append((p, place))
                low, high = max(0, p - place - slack), min(len(words), p - place + n + slack)
                if own and low <= own[-1][1]:
                    own[-1] = (min(own[-1][0], low), max(own[-1][1], high))
                else:
                    own.append((low, high))
        out = []
        for t, own in stretches.items():
            name, template = self.templates[t]
            while own:
                low, high = own.pop()
                pairs = self._dense(patience(template, words[low:high]), len(template))
                if len(pairs) >= self.least_cover * len(template):
                    first, last = low + pairs[0][1], low + pairs[-1][1]
                    out.append((name, len(pairs) / len(template), len(pairs), len(template), first, last))
                    own += [x for x in ((low, first), (last + 1, high)) if x[1] - x[0] >= self.least_cover * len(template)]
                    continue
                # copies that follow each other hide each other's words: align around each key word on its own
                while low < high:
                    near = hits[t][bisect_left(hits[t], (low, -1)) : bisect_left(hits[t], (high, -1))]
                    pairs = next(filter(None, (self._around(template, words, hit, low, high) for hit in near)), None)
                    if pairs is None:
                        break
                    out.append((name, len(pairs) / len(template), len(pairs), len(template), pairs[0][1], pairs[-1][1]))
                    low = pairs[-1][1] + 1
        return self._told_apart(sorted(set(out), key=lambda x: (x[4], x[5], x[0])))

    @staticmethod
    def _told_apart(found: list[tuple]) -> list[tuple]:
        """Of templates of similar size that match the same words, the one that agrees best
        with its stretch (twice the matches by the words of both); ties stay both."""
        open_: list[tuple] = []
        rank = lambda x: 2 * x[2] / (x[3] + x[5] - x[4] + 1)
        beaten = set()
        for x in found:
            open_ = [y for y in open_ if y[5] >= x[4]]
            for y in open_:
                shared, alike = min(x[5], y[5]) - x[4] + 1, max(x[3], y[3]) <= 2 * min(x[3], y[3])
                if x[0] != y[0] and alike and 2 * shared > min(x[5] - x[4], y[5] - y[4]) and rank(x) != rank(y):
                    beaten.add(min(x, y, key=rank))
            open_.append(x)
        return [x for x in found if x not in beaten]

    def _around(self, template: list[str], words: list[str], hit: tuple[int, int], low: int, high: int) -> list[tuple[int, int]]:
        """Matches around a key word (its place in the text, in the template), in a window
        that grows from the template's size until it is covered and grows no better."""
        (p, place), n, best, slack = hit, len(template), [], 0
        have, reach = Counter(template), 2 * n + 20
        if sum((Counter(words[max(low, p - place - reach) : min(high, p - place + n + reach)]) & have).values()) < self.least_cover * n:
            return []
        while True:
            a, b = max(low, p - place - slack), min(high, p - place + n + slack)
            pairs = []
            if sum((Counter(words[a:b]) & have).values()) >= self.least_cover * n:
                left, right = patience(template[:place], words[a:p]), patience(template[place + 1 :], words[p + 1 : b])
                pairs = [*((i, a + j) for i, j in left), (place, p), *((place + 1 + i, p + 1 + j) for i, j in right)]
                pairs = self._dense(pairs, n)
            better = len(pairs) >= self.least_cover * n and len(pairs) > len(best)
            if (best and not better) or slack > n + 8:
                return pairs if better else best
            best, slack = pairs if better else best, 2 * slack + 1

    @staticmethod
    def _dense(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        """The largest run of matches that lies within twice the template's length."""
        best, start = (0, 0), 0
        for end in range(len(pairs)):
            while pairs[end][1] - pairs[start][1] >= 2 * n + 8:
                start += 1
            if end - start + 1 > best[1] - best[0]:
                best = (start, end + 1)
        return pairs[best[0] : best[1]]


LICENSES = "license string, coverage double, matched int, template_words int, first_word int, last_word int"


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, least_cover: float = 0.8) -> DataFrame:
    """doc_id and licenses (array of ``LICENSES``) of every row."""
    ship(docs.sparkSession)
    scanner = LicenseScanner(TEMPLATES if templates is None else templates, least_cover)
    names = [x.split()[0] for x in LICENSES.split(", ")]
    fields = ",".join(":".join(x.split()) for x in LICENSES.split(", "))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.float64()] + [pa.int32()] * 4
        kind = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))
        for batch in batches:
            found = [[dict(zip(names, x, strict=True)) for x in scanner.scan(t.decode("utf-8", "replace"))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "licenses"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id long, licenses array<struct<{fields}>>")
