"""License scans: patience alignment of texts with notice templates.

Words that occur once in the text's range and once in the template's are anchors; the longest increasing subsequence
of their places is kept, and the gaps between are aligned the same way, with words that are unique there. Matches that
lie far from the others are taken off the ends until the match is at most spread (SPREAD) times as wide as the template. What
is left, by the template's words, is the coverage.

A notice that stands several times in a text has no words that are unique there. So where patience leaves words of the
template unmatched, the windows of that width are searched for the most words in the template's order (in_windows); the
better of the two counts. Copies of a notice, however many, don't hide each other: the first of the best is reported.

One word may be all that tells a licence from another: its name, its version, NC. Such words are phrases in TELLING, and a
match must hold them. They are anchors that are given: each place of the first one in the text, with the next places of
those that follow it, is tried, and what lies between and beside them is aligned as above (then, if words are missing, by
the longest common subsequence, over a few template lengths at most). So a near miss of one licence is no match of another.

A template is skipped for a text whose words, counted without their order, can't reach the least coverage: that bound
is never below the coverage, so nothing is lost. Only the places of the template's words are aligned, whatever the
text's length. The templates are a parameter and are shipped with the function (bound: their own size).

Edge cases: null and empty texts match nothing. Rows are independent of each other, so repeated rows get the same
result each. All templates that reach the least coverage are listed; the best one's columns are of that with the highest
coverage, ties to the one with more words, then to the template given first. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import named

SPREAD = 3
MIN_COVERAGE = 0.8
_EDGE = b".,;:!?()[]{}<>\"'`*#/-"

_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: One-line notices in the words of public use, and the public texts and file notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, subject to the following conditions",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "Apache-text": "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "LGPL-text": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": f"""{_BSD_GRANT} {_BSD_DISCLAIMER}""",
    "BSD-3-Clause": f"""{_BSD_GRANT} Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote
the original software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. This notice may not be removed or altered from any source
distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
    "Apache-full-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
}

#: The words that tell a template from its siblings, as phrases in its order. A match must have them all.
TELLING = {
    "Apache-2.0": ("apache", "2.0"),
    "Apache-1.1": ("apache", "1.1"),
    "MIT": ("mit",),
    "GPL-3.0": ("gnu general", "version 3"),
    "GPL-2.0": ("gnu general", "version 2"),
    "CC-BY-NC-4.0": ("by-nc 4.0",),
    "CC-BY-SA-4.0": ("by-sa 4.0",),
    "CC-BY-4.0-short": ("cc by 4.0",),
    "CC-BY-4.0": ("attribution 4.0",),
    "CC-BY-NC-4.0-long": ("attribution-noncommercial 4.0",),
    "CC-BY-SA-4.0-long": ("attribution-sharealike 4.0",),
    "MPL-2.0": ("mozilla", "2.0"),
    "GPL-text": ("program", "gnu general"),
    "LGPL-text": ("library", "gnu lesser general"),
    "AGPL-text": ("program", "gnu affero general"),
    "BSD-3-Clause": ("endorse or promote",),
    "Apache-full-notice": ("apache", "2.0"),
}


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased words without punctuation at their ends; a word of punctuation is empty."""
    return [w.strip(_EDGE) for w in text.lower().split()]


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    tops_at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile:
            back[i] = tops_at[pile - 1]
        if pile == len(tops):
            tops.append(v)
            tops_at.append(i)
        else:
            tops[pile], tops_at[pile] = v, i
    out, i = [], tops_at[-1] if tops_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Matched (place in text, place in template), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        while a < a_end and b < b_end and text[a] == template[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and text[a_end - 1] == template[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            out.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        in_text, in_template = Counter(text[a:a_end]), Counter(template[b:b_end])
        place = {w: i for i, w in enumerate(template[b:b_end], b) if in_template[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:a_end], a) if in_text[w] == 1 and w in place]
        if not anchors:
            continue
        kept = [anchors[i] for i in increasing([x[1] for x in anchors])]
        out += kept
        ends = [(a - 1, b - 1), *kept, (a_end, b_end)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def compact(matches: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """matches without those at the ends, the farther end first, until they lie within most words."""
    low, high = 0, len(matches) - 1
    while low < high and matches[high][0] - matches[low][0] + 1 > most:
        if matches[low + 1][0] - matches[low][0] >= matches[high][0] - matches[high - 1][0]:
            low += 1
        else:
            high -= 1
    return matches[low : high + 1]


def _reached(words: list[bytes], places: list[int], counts: Counter, most: int, need: int) -> list[tuple[int, int]]:
    """Runs of places that windows of most words cover which hold at least need of the template's words in any order."""
    out: list[tuple[int, int]] = []
    have: Counter = Counter()
    low = held = 0
    for high, w in enumerate(words):
        have[w] += 1
        held += have[w] <= counts[w]
        while places[high] - places[low] >= most:
            held -= have[words[low]] <= counts[words[low]]
            have[words[low]] -= 1
            low += 1
        if held >= need:
            if out and low < out[-1][1]:
                out[-1] = (out[-1][0], high + 1)
            else:
                out.append((low, high + 1))
    return out


def in_windows(words: list[bytes], places: list[int], template: list[bytes], most: int, need: int) -> tuple[int, int, int]:
    """(matched words, first and last place) of the longest match in the template's order within most words; 0 below need.

    words: those of the text that the template has, at places. Of matches of equally many words among the template's
    first j the one that starts last is kept: whatever follows, it is the narrowest. A match of need words leaves out
    at most spare of the template's, so only numbers of words that near to j are kept.
    """
    at: dict[bytes, list[int]] = {}
    for j in range(len(template), 0, -1):
        at.setdefault(template[j - 1], []).append(j)
    spare, best = len(template) - need, (0, -1, -1)
    for low, high in _reached(words, places, Counter(template), most, need):
        # starts[j, k]: the last start of a match of k words among the template's first j.
        starts = np.full((len(template) + 1, len(template) + 1), -1, dtype=np.int64)
        for i in range(low, high):
            p = places[i]
            for j in at[words[i]]:
                fewest = max(1, j - spare)
                new = starts[j - 1, fewest - 1 : j].copy()
                new[new <= p - most] = -1
                if fewest == 1:
                    new[0] = p
                rows = starts[j : j + spare + 1, fewest : j + 1]
                np.maximum(rows, new, out=rows)
                k = j if new[-1] >= 0 else fewest + int(np.flatnonzero(new >= 0).max(initial=-1))
                if k >= max(need, best[0] + 1) and new[k - fewest] >= 0:
                    best = (k, int(new[k - fewest]), p)
            if best[0] == len(template):
                return best
    return best


def common(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Matched places of a longest common subsequence; of the equally long ones, those that are last in the text."""
    n, m = len(text), len(template)
    longest = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        above, here, word = longest[i - 1], longest[i], text[i - 1]
        for j in range(1, m + 1):
            here[j] = above[j - 1] + 1 if template[j - 1] == word else max(above[j], here[j - 1])
    out, i, j = [], n, m
    while i and j:
        if text[i - 1] == template[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif longest[i][j - 1] >= longest[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


class Telling:
    """A template's telling phrases, and the matches that hold them."""

    def __init__(self, template: list[bytes], phrases: Sequence[str], spread: int):
        self.template, self.most, self.phrases, at = template, spread * len(template), [], 0
        for phrase in phrases:
            words = phrase.encode().split()
            at = next(i for i in range(at, len(template)) if template[i : i + len(words)] == words)
            self.phrases.append((at, words))
            at += len(words)

    def places(self, words: list[bytes], index: Mapping[bytes, list[int]]) -> Iterator[list[int]]:
        """Places of all phrases in the text, in their order and near enough: one choice for each place of the first."""
        found = [[p for p in index.get(w[0], ()) if words[p : p + len(w)] == w] for _, w in self.phrases]
        if not all(found):
            return
        for first in found[0]:
            chain = [first]
            for (_, before), places in zip(self.phrases, found[1:], strict=False):
                after = bisect_left(places, chain[-1] + len(before))
                if after == len(places):
                    return
                chain.append(places[after])
            if chain[-1] + len(self.phrases[-1][1]) - first <= self.most:
                yield chain

    def best(self, words: list[bytes], index: Mapping[bytes, list[int]]) -> tuple[int, int, int]:
        """(matched words, first and last place) of the longest match that holds the phrases; the first of the longest."""
        best = (0, -1, -1)
        for chain in self.places(words, index):
            ends = [(p + len(w), j + len(w)) for p, (j, w) in zip(chain, self.phrases, strict=True)]
            starts = [(p, j) for p, (j, _) in zip(chain, self.phrases, strict=True)]
            low, high = max(0, ends[-1][0] - self.most), min(len(words), chain[0] + self.most)
            matches = [(p + i, j + i) for (p, j), (_, w) in zip(starts, self.phrases, strict=True) for i in range(len(w))]
            for n, ((a, b), (z, y)) in enumerate(zip([(low, 0), *ends], [*starts, (high, len(self.template))], strict=True)):
                matches += self._gap(words, a, z, b, y, n == 0)
            matches.sort()
            # The ends that lie farther go, but not a telling word.
            inside = chain[0], ends[-1][0] - 1
            while matches[-1][0] - matches[0][0] >= self.most:
                if matches[0][0] < inside[0] and (matches[-1][0] <= inside[1] or matches[1][0] - matches[0][0] >= matches[-1][0] - matches[-2][0]):
                    matches.pop(0)
                else:
                    matches.pop()
            if len(matches) > best[0]:
                best = (len(matches), matches[0][0], matches[-1][0])
            if best[0] == len(self.template):
                break
        return best

    def _gap(self, words: list[bytes], a: int, z: int, b: int, y: int, ahead: bool) -> list[tuple[int, int]]:
        """Matches between two anchors, or beside one: as near to it as they can be (ahead: it follows them)."""
        if a >= z or b >= y:
            return []
        part = self.template[b:y]
        wanted = set(part)
        own = [i for i in range(a, z) if words[i] in wanted]
        text = [words[i] for i in own]
        found = patience(text, part)
        if len(found) < min(len(text), len(part)) or found and own[found[-1][0]] - own[found[0][0]] >= len(part):
            if ahead:
                found = common(text, part)
            else:
                found = [(len(text) - 1 - i, len(part) - 1 - j) for i, j in common(text[::-1], part[::-1])]
        return [(own[i], b + j) for i, j in found]


class Scanner:
    def __init__(self, templates: Mapping[str, str], min_coverage: float, spread: int = SPREAD, telling: Mapping[str, Sequence[str]] | None = None):
        self.least, self.spread = min_coverage, spread
        self.templates = [(name, normal_words(t.encode())) for name, t in templates.items()]
        self.counts = [Counter(words) for _, words in self.templates]
        self.vocabulary = frozenset(w for _, words in self.templates for w in words)
        self.telling = [Telling(words, telling[name], spread) if telling and name in telling else None for name, words in self.templates]

    def scan(self, text: bytes | None) -> tuple[str | None, float, int, int, int]:
        """(template, coverage, matched words, first and last word) of the best; the name is None below the least coverage."""
        return self.best(self.scan_all(text))

    @staticmethod
    def best(found: list[tuple]) -> tuple[str | None, float, int, int, int]:
        return max(found, key=lambda x: x[1:3], default=(None, 0.0, 0, -1, -1))

    def scan_all(self, text: bytes | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, first and last word) of each template that reaches the least coverage."""
        words = normal_words(text or b"")
        present = self.vocabulary.intersection(words)
        out = []
        at: list[int] | None = None
        index: dict[bytes, list[int]] = {}
        for (name, template), counts, telling in zip(self.templates, self.counts, self.telling, strict=True):
            if sum(n for w, n in counts.items() if w in present) < self.least * len(template):
                continue
            if at is None:
                at = [i for i, w in enumerate(words) if w in present]
                for i in at:
                    index.setdefault(words[i], []).append(i)
            if telling is not None:
                n, first, last = telling.best(words, index)
                if n and n / len(template) >= self.least:
                    out.append((name, n / len(template), n, first, last))
                continue
            own = [i for i in at if words[i] in counts]
            matches = [(own[i], j) for i, j in patience([words[i] for i in own], template)]
            matches = compact(matches, self.spread * len(template))
            n, first, last = (len(matches), matches[0][0], matches[-1][0]) if matches else (0, -1, -1)
            if n < len(template):
                need = max(n + 1, next(k for k in range(len(template) + 1) if k / len(template) >= self.least))
                better = in_windows([words[i] for i in own], own, template, self.spread * len(template), need)
                n, first, last = better if better[0] else (n, first, last)
            coverage = n / len(template)
            if n and coverage >= self.least:
                out.append((name, coverage, n, first, last))
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE, spread: int = SPREAD, telling: Mapping[str, Sequence[str]] = TELLING) -> DataFrame:
    """id, license (null: none), coverage, n_matched, first_word, last_word (numbers of words, -1: none) of each row's best, and licenses, an array of the same of all.

    A match is at most spread times as wide as its template, and holds the telling phrases of its template, if telling has any
    by its name and templates are the ones given here or name their own.
    """
    templates, telling = dict(templates), {} if templates is not TEMPLATES and telling is TELLING else dict(telling)
    kind = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage, spread, telling)
        for b in batches:
            every = [scanner.scan_all(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            name, coverage, n, first, last = zip(*map(scanner.best, every), strict=True) if every else [()] * 5
            listed = pa.array([[dict(zip(kind.names, x, strict=True)) for x in found] for found in every], type=pa.list_(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, type=pa.string()), pa.array(coverage, type=pa.float64()), *(pa.array(x, type=pa.int64()) for x in (n, first, last)), listed], names=[id_col, *kind.names, "licenses"])

    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    fields = "license string, coverage double, n_matched long, first_word long, last_word long"
    return rows.mapInArrow(run, f"`{id_col}` long, {fields}, licenses array<struct<{fields}>>")
