"""Licence scans by a generalised suffix automaton of licence words.

One automaton holds the words of all templates.  A text's words are streamed through it, which gives the matching statistics:
after each word, the longest run of words ending there that some template holds, and with the suffixes of its state the longest
of every template.  Matches of ``LEAST`` words or more, as long as they go in a template, are chained, in order in the text and
in the template and at most ``GAP`` words apart in the text; a template counts as found where a chain covers ``SHARE`` of its words.

Base phrases are in the automaton too.  A phrase ends at a word exactly if its state is the one that the stream is in, with a match
no shorter than the phrase, or one of that state's suffixes: these are marked beforehand.

Null texts count as empty; texts without words have no places, no labels and a score of 0; very long texts are streamed
whole.  Repeated rows and null ids are rows of their own; an empty table gives an empty one; other columns, whatever their
names, are not read.  Ties between chains go to the earlier one.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a long match; words of the text between chained matches, at most; share of a template's words that is covered.
LEAST, GAP, SHARE = 4, 64, 0.9
#: A-Z to small letters, every other sign of ASCII but letters and digits to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Phrases and their labels. Fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Names and texts of public licences, without the parts that vary. Fixed values.
TEMPLATES = (
    ("apache-2.0", "Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("mit", "under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl-3.0", "GNU Affero General Public License"),
    ("mpl-2.0", "Mozilla Public License, v. 2.0"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""),
    ("cc0-1.0", "CC0 1.0 Universal"),
    ("cc-by-4.0", "CC BY 4.0"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd-4.0", "CC BY-NC-ND 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and signs beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of sequences of words; state 0 is the empty match."""

    def __init__(self, texts: list[list[bytes]], phrases: list[list[bytes]]):
        self.codes: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.found: list[list[tuple[int, int]]] = [[]]
        for k, text in enumerate([*texts, *phrases]):
            last = 0
            for i, word in enumerate(text):
                last = self._extend(last, self.codes.setdefault(word, len(self.codes)))
                if k < len(texts):
                    self.found[last].append((k, i + 1))
        longest_first = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for v in longest_first:  # what ends with a state's words also ends with its suffix
            if self.link[v] > 0:
                self.found[self.link[v]] += self.found[v]
        self.found = [sorted(set(f)) for f in self.found]
        self.ends: dict[int, list[tuple[tuple[int, int], int]]] = {}
        self.marks: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for k, phrase in enumerate(phrases):
            v = 0
            for word in phrase:
                v = self.next[v][self.codes[word]]
            self.marks[v] += ((len(phrase), k),)
        for v in reversed(longest_first):
            self.marks[v] += self.marks[self.link[v]]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        self.found.append([])
        return len(self.length) - 1

    def _split(self, at: int, code: int) -> int:
        """The state of ``at``'s longest words and ``code`` after it: the one there is, or its copy of just that length."""
        to = self.next[at][code]
        if self.length[to] == self.length[at] + 1:
            return to
        copy = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while at >= 0 and self.next[at].get(code) == to:
            self.next[at][code] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, code: int) -> int:
        if code in self.next[last]:
            return self._split(last, code)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and code not in self.next[at]:
            self.next[at][code] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, code)
        return new

    def ends_at(self, v: int, least: int) -> list[tuple[tuple[int, int], int]]:
        """Places in templates (template, end) that a match in state ``v`` ends at, with the most words that match there."""
        if v not in self.ends:
            out: dict[tuple[int, int], int] = {}
            most, at = 1 << 62, v
            while at > 0 and (at == v or self.length[at] >= least):
                for f in self.found[at]:
                    out.setdefault(f, most)
                at = self.link[at]
                most = self.length[at]
            self.ends[v] = list(out.items())
        return self.ends[v]

    def stream(self, words: list[bytes], least: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
        """Long matches (end, length, template, end in it) that go no further, by end, and places of phrases (start, phrase)."""
        step, link, length, marks = self.next, self.link, self.length, self.marks
        matches, places = [], []
        held: dict[tuple[int, int], int] = {}
        v = n = 0
        for i, c in enumerate(chain(map(self.codes.get, words), [None])):
            if c is None:
                v = n = 0
            else:
                while v and c not in step[v]:
                    v = link[v]
                    n = length[v]
                if c in step[v]:
                    v = step[v][c]
                    n += 1
                    for size, k in marks[v]:
                        if size <= n:
                            places.append((i + 1 - size, k))
            if held or n >= least:
                now = {f: min(n, most) for f, most in self.ends_at(v, least)} if n >= least else {}
                matches += [(i, size, k, end) for (k, end), size in held.items() if (k, end + 1) not in now]
                held = now
        return matches, places


def chains(matches: list[tuple[int, int, int, int]], gap: int) -> dict[int, tuple[int, int, int]]:
    """Of each template the best chain: words covered, start and end in the text (negated, so that the greatest is the earliest)."""
    live: dict[int, list[tuple[int, int, int, int]]] = {}
    best: dict[int, tuple[int, int, int]] = {}
    for end, n, template, t_end in matches:
        near = [c for c in live.get(template, []) if c[1] >= end - n - gap]
        covered, start = n, end - n
        for c_start, c_end, c_t_end, c_covered in near:
            more = n - max(0, c_end - (end - n), c_t_end - (t_end - n))  # words that both hold count once
            if more > 0 and c_covered + more > covered:
                covered, start = c_covered + more, c_start
        near.append((start, end, t_end, covered))
        live[template] = near
        best[template] = max(best.get(template, (0, 0, 0)), (covered, -start, -end))
    return best


@lru_cache(maxsize=4)
def automaton_of(templates: tuple, phrases: tuple) -> Automaton:
    return Automaton([words_of(t) for _, t in templates], [words_of(p) for p, _ in phrases])


def scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, least: int = LEAST, gap: int = GAP, share: float = SHARE) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text): doc_id, n_words, base, spans and score.

    base: places of phrases (start, label), by start; spans: found templates (label, start, end, covered), by label and start, words
    counted from 0, ends exclusive; score: the highest share of a template that a chain covers.
    """

    def run(batches):
        automaton = automaton_of(templates, phrases)
        sizes = [len(words_of(t)) for _, t in templates]
        for b in batches:
            rows = []
            for t in b.column(1):
                words = words_of(t.as_py())
                matches, places = automaton.stream(words, least)
                base = [{"start": s, "label": phrases[k][1]} for s, k in sorted(places)]
                best = chains(matches, gap)
                spans = [{"label": templates[k][0], "start": -s, "end": -e, "covered": n / sizes[k]} for k, (n, s, e) in best.items() if n >= share * sizes[k]]
                score = max((n / sizes[k] for k, (n, _, _) in best.items()), default=0.0)
                rows.append((len(words), base, sorted(spans, key=lambda x: (x["label"], x["start"], x["end"])), score))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_words", "base", "spans", "score"])

    place = [("start", pa.int64()), ("label", pa.string())]
    span = [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]
    kinds = [pa.int64(), pa.list_(pa.struct(place)), pa.list_(pa.struct(span)), pa.float64()]
    schema = "doc_id long, n_words long, base array<struct<start: long, label: string>>, spans array<struct<label: string, start: long, end: long, covered: double>>, score double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
