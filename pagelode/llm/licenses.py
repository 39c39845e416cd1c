"""Licence scans with a generalised suffix automaton over the words of licence texts.

The words of a document stream through the automaton, which gives at every word the longest run that
ends there and occurs in some template (its matching statistics), and along its suffix links the longest
one of each other template. Long runs are chained where they follow each other in one template, each
with its best predecessor; a chain that covers enough of the template is a found span.
A word that no template has takes the automaton back to its start, so only stretches of known words
need to be streamed, and a stretch below the shortest run of interest has nothing to find.

Null and empty texts have no words and no labels; repeated rows are scanned each; extra columns are
ignored. Chains of one template do not overlap. A chain within the span of one that covers more words, or
as many and more of its template, is left out, so a notice counts as the version it agrees with most; of
equal ones all stay.
"""

from __future__ import annotations

import re
from bisect import bisect, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.words import ALPHANUMERIC, pieces, split_words, text_array

#: Phrases that name a licence wherever they stand.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Licence texts without their copyright lines: fixed public texts.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""


def gnu_notice(name: str, version: str) -> str:
    """How the GNU licences ask a file to name them."""
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
            f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) "
            f"any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
            f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} "
            f"for more details.")


#: Whole texts and notices of common licences, their beginnings, and the short forms that documents use.
TEMPLATES = (
    ("mit", MIT),
    ("isc", ISC),
    ("bsd-2-clause", f"{BSD_CONDITIONS}\n{BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{BSD_CONDITIONS}\n{BSD_THIRD}\n{BSD_DISCLAIMER}"),
    ("zlib", ZLIB),
    ("apache-2.0", APACHE_NOTICE),
    ("gpl-2.0", gnu_notice("General Public License", "2")),
    ("gpl-3.0", gnu_notice("General Public License", "3")),
    ("lgpl-2.1", gnu_notice("Lesser General Public License", "2.1")),
    ("lgpl-3.0", gnu_notice("Lesser General Public License", "3")),
    ("agpl-3.0", gnu_notice("Affero General Public License", "3")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0 which is available at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "All rights reserved"),
)


def template_words(text: str) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def read_templates(templates: DataFrame, most_chars: int = 4_000_000) -> tuple[tuple[str, str], ...]:
    """The (label, text) rows of a table of licence texts, in order; rows with a null in either are left out.

    Every task gets them all, so a table with more than ``most_chars`` characters is an error, not cut.
    """
    rows = templates.select("label", "text").where("label IS NOT NULL AND length(text) > 0").distinct()
    size = rows.agg(F.sum(F.length("text") + F.length("label"))).first()[0] or 0
    if size > most_chars:
        raise ValueError(f"the licence texts have {size} characters, more than {most_chars}")
    return tuple((r.label, r.text) for r in rows.orderBy("label", "text").collect())


class LicenseAutomaton:
    """The automaton of all templates; each state gives where its runs end in each template."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [label for label, _ in templates]
        self.texts = [template_words(text) for _, text in templates]
        self.moves: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.own: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(self.texts):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, word)
                self.own[last].append((t, i))
        self.below: list[list[int]] = [[] for _ in self.link]
        for state, link in enumerate(self.link[1:], 1):
            self.below[link].append(state)
        self._ends: dict[int, dict[int, list[int]]] = {}

    def ends(self, state: int) -> dict[int, list[int]]:
        """By template, the places of the last words of all occurrences of the state's runs."""
        if state not in self._ends:
            found: dict[int, list[int]] = {}
            todo = [state]
            while todo:
                at = todo.pop()
                todo.extend(self.below[at])
                for t, i in self.own[at]:
                    found.setdefault(t, []).append(i)
            self._ends[state] = {t: sorted(places) for t, places in found.items()}
        return self._ends[state]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.own.append([])
        return len(self.moves) - 1

    def _split(self, p: int, q: int, word: str) -> int:
        clone = self._state(self.length[p] + 1, dict(self.moves[q]), self.link[q])
        while p >= 0 and self.moves[p].get(word) == q:
            self.moves[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: str) -> int:
        if word in self.moves[last]:
            q = self.moves[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        state = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.moves[p]:
            self.moves[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.moves[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return state

    def runs(self, words: list[str], start: int, least: int) -> Iterator[tuple[int, int, int, list[int]]]:
        """(template, first word, length, ends in the template) of each run that no neighbour extends in that template."""
        state, length = 0, 0
        before: dict[int, tuple[int, int]] = {}
        for i, word in enumerate([*words, None]):
            while state and word not in self.moves[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.moves[state]:
                state = self.moves[state][word]
                length += 1
            now: dict[int, tuple[int, int]] = {}
            at, size = state, length
            while size >= least:
                for t in self.ends(at):
                    now.setdefault(t, (size, at))
                at = self.link[at]
                size = self.length[at]
            for t, (size, at) in before.items():
                if t not in now or now[t][0] <= size:
                    yield t, start + i - size, size, self.ends(at)[t]
            before = now

    def chains(self, runs: list[tuple[int, int, int, list[int]]], gap: int,
               least_share: float) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, share of the template) of each chain that covers enough."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for t, at, size, ends in runs:
            by_template.setdefault(t, []).extend((at, at + size, end + 1) for end in ends)
        found = []
        for t, nodes in by_template.items():
            size = len(self.texts[t])
            found += [(first, end, (covered, covered / size), t)
                      for first, end, covered in _best_chains(nodes, gap, least_share * size)]
        kept, around = [], []
        for first, end, worth, t in sorted(found, key=lambda c: (c[0], -c[1], -c[2][0], -c[2][1], c[3])):
            around = [o for o in around if o[0] > first]
            if not any(o[0] >= end and o[1] > worth for o in around):
                kept.append((self.labels[t], first, end, worth[1]))
                around.append((end, worth))
        return kept


def _best_chains(nodes: list[tuple[int, int, int]], gap: int, least: float) -> list[tuple[int, int, int]]:
    """(first word, word after the last, words covered) of chains of at least ``least`` words that do not overlap.

    A node is a run: its first word, the word after its last, and that one's place in the template. Runs
    that overlap, in the text or in the template, count from where the run before ends.
    """
    covered, first = [], []
    for j, (at, end, place) in enumerate(nodes):
        size = end - at
        best, begin = size, at
        for i in range(j - 1, -1, -1):
            _, end_before, place_before = nodes[i]
            if end_before < at - gap:
                break
            cut = max(0, end_before - at, place_before - (place - size))
            if cut < size and at + cut - end_before <= gap and covered[i] + size - cut > best:
                best, begin = covered[i] + size - cut, first[i]
        covered.append(best)
        first.append(begin)
    taken: list[tuple[int, int, int]] = []
    for j in sorted(range(len(nodes)), key=lambda j: (-covered[j], first[j], nodes[j][1])):
        if covered[j] < least:
            break
        span = (first[j], nodes[j][1], covered[j])
        k = bisect(taken, span)
        if (k == 0 or taken[k - 1][1] <= span[0]) and (k == len(taken) or span[1] <= taken[k][0]):
            insort(taken, span)
    return taken


@lru_cache(maxsize=2)
def _automaton(templates: tuple[tuple[str, str], ...]) -> LicenseAutomaton:
    """Built once by each worker process, for all of its tasks."""
    return LicenseAutomaton(templates)


SPAN_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()),
    T.StructField("end_word", T.LongType()), T.StructField("share", T.DoubleType())]))

_SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()),
                                 ("share", pa.float64())]))


def scan_licenses(docs: DataFrame, templates: DataFrame | tuple = TEMPLATES, phrases=PHRASES, least_run: int = 3, gap: int = 8,
                  least_share: float = 0.75) -> DataFrame:
    """``doc_id``, ``n_words``, the places of the phrases and the licence spans of each whole text.

    ``base_places`` has (label, first word, word after the last, 1.0) of each phrase; ``spans`` has the
    chains that cover ``least_share`` of a template, of runs of at least ``least_run`` words that are at
    most ``gap`` words apart. ``templates`` are (label, text) pairs, or a table with these columns.
    """
    given = read_templates(templates) if isinstance(templates, DataFrame) else tuple(map(tuple, templates))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("base_places", SPAN_SCHEMA), T.StructField("spans", SPAN_SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(given)
        wanted = [(template_words(p), label) for p, label in phrases]
        known = sorted({w for t in automaton.texts for w in t} | {w for p, _ in wanted for w in p})
        hashes = split_words(pa.array([" ".join(known)]), ALPHANUMERIC).hashes
        order = np.argsort(hashes)
        sorted_hashes, by_hash = hashes[order], [known[i] for i in order]
        code_of = {w: i for i, w in enumerate(by_hash)}
        for piece in pieces(batches):
            words = split_words(text_array(piece.column("text")), ALPHANUMERIC)
            n = piece.num_rows
            base: list[list] = [[] for _ in range(n)]
            spans: list[list] = [[] for _ in range(n)]
            if len(words.hashes):
                place = np.searchsorted(sorted_hashes, words.hashes)
                place[place == len(sorted_hashes)] = 0
                codes = np.where(sorted_hashes[place] == words.hashes, place, -1)
                _places_of_phrases(base, words, codes, [([code_of[w] for w in p], label) for p, label in wanted])
                for i, runs in _runs(automaton, words, codes, by_hash, least_run).items():
                    spans[i] = automaton.chains(runs, gap, least_share)
            as_dicts = lambda rows: pa.array(
                [[dict(zip(("label", "first_word", "end_word", "share"), r)) for r in row] for row in rows], _SPAN_TYPE)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(words.counts.astype(np.int64)), as_dicts(base), as_dicts(spans)],
                names=["doc_id", "n_words", "base_places", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _places_of_phrases(base, words, codes, phrases):
    """Every place where the words of a phrase follow each other in one text."""
    for phrase, label in phrases:
        size = len(phrase)
        if len(codes) < size:
            continue
        hit = words.doc[:len(codes) - size + 1] == words.doc[size - 1:]
        for k, code in enumerate(phrase):
            hit &= codes[k:len(codes) - size + 1 + k] == code
        for at in np.flatnonzero(hit):
            i = words.doc[at]
            first = int(at - words.offsets[i])
            base[i].append((label, first, first + size, 1.0))


def _runs(automaton, words, codes, by_hash, least_run):
    """Long runs by text, from the stretches of known words that are long enough."""
    known = np.concatenate(([False], codes >= 0, [False]))
    edges = np.flatnonzero(known[1:] != known[:-1])
    found: dict[int, list] = {}
    for start, end in zip(edges[0::2].tolist(), edges[1::2].tolist()):
        if end - start < least_run:
            continue
        a = start
        while a < end:  # a stretch may go on into the next text
            i = int(words.doc[a])
            b = min(end, int(words.offsets[i + 1]))
            if b - a >= least_run:
                own = [by_hash[c] for c in codes[a:b]]
                found.setdefault(i, []).extend(automaton.runs(own, a - int(words.offsets[i]), least_run))
            a = b
    return found
