"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of every template. A text is streamed
through it word by word, which gives at each word the longest run that ends
there and stands in some template (matching statistics), and over the suffix
links the longest that ends at each place of each other template. Runs of at
least MIN_MATCH words that can't be extended at their place in a template, though
another template may hold a longer one, are chained, in order in both; a chain that covers enough of a template is
a finding. Words no template has reset the automaton, so only stretches of
licence words are streamed; these are found by numpy for whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import _tokens as T
from rillstone.llm._common import slices

#: Shortest run that counts, share of the template that a chain must cover, and the words that may lie between two runs.
MIN_MATCH, COVERAGE, GAP = 3, 0.75, 12

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_2 = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = {
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY,
    "MIT-notice": "Released under the MIT License",
    "BSD-2-Clause": _BSD_1 + " " + _BSD_2,
    "BSD-3-Clause": _BSD_1 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_2,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Templates from text files, one each, named as the files without their endings: for full texts, which aren't kept here. The library is bounded and goes to the driver."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), "value").collect()
    return {r["name"]: r["value"] for r in rows}


class SuffixAutomaton:
    """Of several sequences of hashable symbols; a state knows the places (sequence, end) where its runs end."""

    def __init__(self, sequences: list[list]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for end, symbol in enumerate(sequence, 1):
                last = self._extend(last, symbol)
                self.ends[last].add((number, end))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol) -> int:
        q = self.next[last].get(symbol)
        if q is not None:  # another sequence has been here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
        return new

    def statistics(self, symbols: list) -> list[tuple[int, int]]:
        """At each symbol, the length of the longest run that ends there and stands in a sequence, and its state."""
        state, length, out = 0, 0, []
        for s in symbols:
            while state and s not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if s in self.next[state]:
                state = self.next[state][s]
                length += 1
            out.append((length, state))
        return out


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, min_match: int = MIN_MATCH, coverage: float = COVERAGE, gap: int = GAP):
        self.names = sorted(templates if templates is not None else TEMPLATES)
        sequences = [T.word_hashes((templates if templates is not None else TEMPLATES)[n]).tolist() for n in self.names]
        self.lengths = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences)
        self.vocabulary = np.array(sorted({w for s in sequences for w in s}), np.uint64)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.min_match, self.coverage, self.gap = min_match, coverage, gap

    def stretches(self, hashes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, first, end) of runs of at least min_match words that templates have; positions among all rows' words."""
        known = self.bitmap[(hashes >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(known)
        if not len(at) or not len(self.vocabulary):
            return
        number = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        at = at[self.vocabulary[number] == hashes[at]]
        row = np.searchsorted(offsets, at, "right") - 1
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row) != 0)) + 1
        for part in np.split(np.arange(len(at)), cut):
            if len(part) >= self.min_match:
                yield int(row[part[0]]), int(at[part[0]]), int(at[part[-1]]) + 1

    def matches(self, symbols: list, base: int) -> list[tuple[int, int, int, int]]:
        """(template, first word in the text, first word in the template, length) of the runs that can't be extended at that place of the template."""
        out = []
        running: dict[tuple[int, int], int] = {}
        for i, (length, state) in enumerate([*self.automaton.statistics(symbols), (0, 0)]):
            places: dict[tuple[int, int], int] = {}
            while length >= self.min_match:
                for place in self.automaton.ends[state]:
                    places.setdefault(place, length)
                state = self.automaton.link[state]
                length = self.automaton.length[state]
            out += [(t, base + i - n, end - n, n) for (t, end), n in running.items() if (t, end + 1) not in places]
            running = places
        return out

    def chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, end word) of chains that cover enough of a template; of overlapping ones of a template, the best."""
        out = []
        by: dict[int, list[tuple[int, int, int]]] = {}
        for t, x, y, n in matches:
            by.setdefault(t, []).append((x, y, n))
        for t, own in sorted(by.items()):
            own.sort()
            longest = max(n for _, _, n in own)
            score, back = [], []
            for k, (x, y, n) in enumerate(own):
                best, came = n, -1
                for j in range(k - 1, -1, -1):
                    a, b, m = own[j]
                    if x - a > self.gap + longest:
                        break
                    overlap = max(0, a + m - x, b + m - y)
                    if a < x and b < y and overlap < n and x - a - m <= self.gap and y - b - m <= max(self.gap, self.lengths[t] // 4) and score[j] + n - overlap > best:
                        best, came = score[j] + n - overlap, j
                score.append(best)
                back.append(came)
            taken: list[tuple[int, int]] = []
            for k in sorted(range(len(own)), key=lambda k: (-score[k], own[k])):
                if score[k] < self.coverage * self.lengths[t]:
                    break
                first = k
                while back[first] >= 0:
                    first = back[first]
                span = (own[first][0], own[k][0] + own[k][2])
                if all(span[1] <= a or b <= span[0] for a, b in taken):
                    taken.append(span)
                    out.append((self.names[t], score[k] / self.lengths[t], *span))
        return out

    def scan(self, values: pa.Array) -> Iterator[tuple[int, str, float, int, int]]:
        """(row, template, coverage, first word, end word)"""
        hashes, _, _, offsets = T.words(T.column(values))
        found: dict[int, list] = {}
        for row, first, end in self.stretches(hashes, offsets):
            found.setdefault(row, []).extend(self.matches(hashes[first:end].tolist(), first - int(offsets[row])))
        for row, matches in found.items():
            for chain in self.chains(matches):
                yield row, *chain


def _scan(batches: Iterator[pa.RecordBatch], scanner: Scanner) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        rows = list(scanner.scan(batch["text"]))
        ids = batch["doc_id"].take(pa.array([r[0] for r in rows], pa.int64()))
        columns = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
        yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "template", "coverage", "first_word", "end_word"])


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, template, coverage, first_word, end_word): the licence texts that documents hold.

    docs: doc_id, text; other columns are ignored. Null and empty texts hold
    none; repeated rows are scanned each, rows without an id are reported with
    a null doc_id; an empty table gives no rows. A notice that is part of a
    longer template is reported too. The templates are the only state that goes
    to executors, and don't grow with the corpus.
    """
    scanner = scanner or Scanner()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _scan(it, scanner), "doc_id long, template string, coverage double, first_word long, end_word long")
