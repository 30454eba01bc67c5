"""Licence scans: matching statistics over a suffix automaton of licence notices, then chaining.

The words of all notices and of the fixed base phrases go into one generalised suffix automaton.
A text is streamed through it: at each word the automaton gives the longest run of words ending
there that occurs in some notice. Runs that cannot grow in a notice are its matches; matches of one notice that
keep their order, in the text as in the notice, are chained into spans, and a span that covers
enough of the notice, its telling words among them, gives its label. Of spans that hold
mostly the same words the one that holds most stays. Base phrases are read off the suffix links of the states
passed, so every place of every phrase is found.

The notices are a fixed list, so the automaton that tasks receive does not grow with the input;
every text is judged alone and nothing is shuffled. Only stretches of words whose neighbouring
pairs occur in some notice are walked; elsewhere no match is longer than one word.

Defined results: null, empty and blank texts have no words, empty labels, null places and score 0;
rows are judged one by one, so repeated rows agree; all input columns are carried along under
their names; the new ones are a struct whose name is a parameter.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.llm.tokens import Words, chunks

# Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
GNU_HEADER = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} Public "
    "License as published by the Free Software Foundation; either version {2} of the License, or (at your option) "
    "any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} "
    "Public License for more details."
)

# Notices as their licences word them, by SPDX label.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("bsd-2-clause", BSD_CLAUSES),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("all-rights-reserved", "All rights reserved"),
    ("gpl-2.0", GNU_HEADER.format("program", "General", "2")),
    ("lgpl-2.0", GNU_HEADER.format("library", "Library General", "2")),
    ("lgpl-2.1", GNU_HEADER.format("library", "Lesser General", "2.1")),
    ("lgpl-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", GNU_HEADER.format("program", "Lesser General", "3")),
    ("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3.0", GNU_HEADER.format("program", "Affero General", "3")),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3"),
    (
        "bsd-3-clause",
        BSD_CLAUSES + " Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "bsd-4-clause",
        BSD_CLAUSES + " All advertising materials mentioning features or use of this software must display the "
        "following acknowledgement: This product includes software developed by the copyright holder. Neither the name "
        "of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
    ),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License"),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License"),
    (
        "cc0-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
        "rights to this software to the public domain worldwide. This software is distributed without any warranty. "
        "You should have received a copy of the CC0 Public Domain Dedication along with this software.",
    ),
    ("cc0-1.0", "Licensed under CC0 1.0"),
    (
        "0bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted. THE SOFTWARE IS PROVIDED",
    ),
)

# Words that tell a licence from its neighbours. A span must hold those that its notice holds.
TELLING = {
    "apache-2.0": ("version 2 0",),
    "gpl-2.0": ("gnu general public", "version 2"),
    "gpl-3.0": ("gnu general public", "version 3"),
    "lgpl-2.0": ("gnu library general public", "version 2"),
    "lgpl-2.1": ("gnu lesser general public", "version 2 1"),
    "lgpl-3.0": ("gnu lesser general public", "version 3"),
    "agpl-3.0": ("gnu affero general public", "version 3"),
    "cc-by-4.0": ("by 4 0", "attribution 4 0"),
    "cc-by-sa-4.0": ("by sa 4 0", "attribution sharealike 4 0"),
    "cc-by-nc-4.0": ("by nc 4 0", "attribution noncommercial 4 0"),
    "bsd-2-clause": ("bsd 2 clause",),
    "bsd-3-clause": ("neither the name", "bsd 3 clause"),
    "bsd-4-clause": ("all advertising materials",),
    "cc0-1.0": ("cc0",),
    "0bsd": ("hereby granted the software is provided",),
}

MIN_MATCH = 3  # words of a match that may be chained
MAX_GAP = 20  # words between two matches of a chain, in the text or in the notice
MIN_COVER = 0.8  # share of a notice's words that a span must hold

APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

RESULT = (
    "struct<n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label string, first_word long, last_word long, cover double>>>"
)


def notice_words(text: str) -> list[str]:
    words = Words(pa.array([text]), APART)
    return [words.text(i) for i in range(len(words.starts))]


def word_code(word: str) -> int:
    return int(Words(pa.array([word]), APART).codes()[0])


class Automaton:
    """A generalised suffix automaton over token ids, with the places where each state's runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.longest = [0]
        self.places: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            at = 0
            for end, token in enumerate(sequence):
                at = self._extend(at, token)
                self.places[at].add((number, end))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.longest[s]):
            self.places[self.link[state]] |= self.places[state]

    def _new(self, longest: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.longest.append(longest)
        self.link.append(link)
        self.places.append(set())
        return len(self.link) - 1

    def _split(self, parent: int, token: int, longest: int) -> int:
        """A state for the runs of at most ``longest`` words among those reached from ``parent``."""
        old = self.next[parent][token]
        copy = self._new(longest, dict(self.next[old]), self.link[old])
        self.link[old] = copy
        while parent >= 0 and self.next[parent].get(token) == old:
            self.next[parent][token] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, token: int) -> int:
        length = self.longest[last] + 1
        if token in self.next[last]:
            known = self.next[last][token]
            return known if self.longest[known] == length else self._split(last, token, length)
        new, parent = self._new(length, {}, 0), last
        while parent >= 0 and token not in self.next[parent]:
            self.next[parent][token] = new
            parent = self.link[parent]
        if parent >= 0:
            known = self.next[parent][token]
            short = self.longest[parent] + 1
            self.link[new] = known if self.longest[known] == short else self._split(parent, token, short)
        return new

    def stream(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest run ending at each token that occurs in some sequence."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.longest[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
            yield state, length


class Scanner:
    """The automaton of the notices and base phrases, and the scan of texts with it."""

    def __init__(self, notices=NOTICES, phrases=BASE_PHRASES, min_cover: float = MIN_COVER):
        self.labels = [label for label, _ in notices]
        self.phrases = list(phrases.values())
        texts = [notice_words(text) for _, text in notices] + [p.split(" ") for p in phrases]
        self.min_cover = min_cover
        self.telling = [
            [
                [word_code(w) for w in phrase.split(" ")]
                for phrase in TELLING.get(label, ())
                if f" {phrase} " in f" {' '.join(own)} "
            ]
            for label, own in zip(self.labels, texts, strict=False)
        ]
        vocabulary = sorted({w for words in texts for w in words})
        ids = {w: i for i, w in enumerate(vocabulary)}
        sequences = [[ids[w] for w in words] for words in texts]
        self.sizes = [len(s) for s in sequences]
        codes = np.array([word_code(w) for w in vocabulary], np.uint64)
        order = np.argsort(codes)
        self.keys, self.ids = codes[order], order
        self.width = len(vocabulary)
        pairs = {a * self.width + b for s in sequences for a, b in zip(s, s[1:], strict=False)}
        self.pairs = np.array(sorted(pairs))
        self.automaton = Automaton(sequences)
        n_notices = len(notices)
        # Base phrases that are suffixes of a state's runs: its own and those of its suffix link.
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]
        for state in sorted(range(1, len(self.whole)), key=lambda s: self.automaton.longest[s]):
            shorter = self.automaton.longest[self.automaton.link[state]]  # the state's runs are longer than that
            own = {
                (number - n_notices, self.sizes[number])
                for number, end in self.automaton.places[state]
                if number >= n_notices and end == self.sizes[number] - 1 and shorter < end + 1 <= self.automaton.longest[state]
            }
            self.whole[state] = sorted(own.union(self.whole[self.automaton.link[state]]))
        # Where each notice holds a state's runs or, if it holds only their ends, so many last words of them;
        # and the token that goes on there.
        following = [[*sequence[1:], -1] for sequence in sequences]
        self.notice_places: list[list[tuple[int, int, int, int]]] = [[] for _ in self.automaton.link]
        for state in sorted(range(1, len(self.whole)), key=lambda s: self.automaton.longest[s]):
            longest, link = self.automaton.longest[state], self.automaton.link[state]
            own = [(n, e) for n, e in sorted(self.automaton.places[state]) if n < n_notices]
            self.notice_places[state] = [(n, e, longest, following[n][e]) for n, e in own if longest >= MIN_MATCH]
            known = set(own)
            self.notice_places[state] += [p for p in self.notice_places[link] if p[:2] not in known]

    def stretches(self, words: Words) -> Iterator[tuple[int, np.ndarray]]:
        """First word and token ids of every maximal stretch whose neighbouring pairs are known."""
        codes = words.codes()
        if len(codes) < 2:
            return
        at = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
        token = np.where(self.keys[at] == codes, self.ids[at], -1)
        doc = words.doc
        pair = np.where((token[:-1] >= 0) & (token[1:] >= 0), token[:-1] * self.width + token[1:], -1)
        spot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        linked = np.concatenate([[False], (self.pairs[spot] == pair) & (doc[:-1] == doc[1:]), [False]]).astype(np.int8)
        step = np.diff(linked)
        for first, last in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
            yield int(first), token[first : last + 1]

    def scan(self, texts: pa.Array) -> list[dict]:
        words = Words(texts, APART)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        matches: dict[int, dict[int, list[tuple[int, int, int]]]] = defaultdict(lambda: defaultdict(list))
        for first, tokens in self.stretches(words):
            row = int(np.searchsorted(words.first_word, first, side="right")) - 1
            base = first - int(words.first_word[row])
            after = [*tokens[1:].tolist(), -1]
            for i, (state, length) in enumerate(self.automaton.stream(tokens.tolist())):
                for phrase, size in self.whole[state]:
                    if length >= size:
                        hits[row].append((phrase, base + i - size + 1))
                if length >= MIN_MATCH:
                    for number, end, longest, follows in self.notice_places[state]:
                        if follows < 0 or follows != after[i]:
                            own = min(length, longest)
                            matches[row][number].append((base + i - own + 1, end - own + 1, own))
        codes, first_word = words.codes(), words.first_word
        return [
            self._result(codes[first_word[row] : first_word[row] + n], hits.get(row, []), matches.get(row, {}))
            for row, n in enumerate(words.counts)
        ]

    def _spans(self, codes: np.ndarray, matches: dict) -> list[dict]:
        """Spans with their telling words; of those that hold mostly the same words, the one with most."""
        found = [
            (len(held), cover, first, last, self.labels[number], held)
            for number, runs in sorted(matches.items())
            for first, last, cover, held in chained(runs, self.sizes[number], self.min_cover)
            if all(holds(codes[first : last + 1].tolist(), phrase) for phrase in self.telling[number])
        ]
        kept: list[tuple] = []
        owners: dict[int, list[int]] = {}  # kept spans that hold a word
        for span in sorted(found, key=lambda s: (-s[0], -s[1], *s[2:5])):
            shared = Counter(owner for word in span[5] for owner in owners.get(word, ()))
            if 2 * max(shared.values(), default=0) <= span[0]:
                for word in span[5]:
                    owners.setdefault(word, []).append(len(kept))
                kept.append(span)
        return [
            {"label": label, "first_word": first, "last_word": last, "cover": cover}
            for _, cover, first, last, label, _ in kept
        ]

    def _result(self, codes: np.ndarray, hits: list[tuple[int, int]], matches: dict) -> dict:
        spans = self._spans(codes, matches) if matches else []
        base = sorted({self.phrases[p] for p, _ in hits})
        places = [at for _, at in hits]
        return {
            "n_words": len(codes),
            "n_base": len(hits),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(base),
            "labels": ",".join(sorted({*base, *(s["label"] for s in spans)})),
            "score": max([1.0 if hits else 0.0, *(s["cover"] for s in spans)]),
            "spans": sorted(spans, key=lambda s: (s["first_word"], s["last_word"], s["label"])),
        }


def holds(codes: list[int], phrase: list[int]) -> bool:
    return any(codes[i : i + len(phrase)] == phrase for i in range(len(codes) - len(phrase) + 1))


def chained(found: list[tuple[int, int, int]], size: int, least: float) -> list[tuple[int, int, float, set[int]]]:
    """Spans (first word, last word, cover, places of the words held) of chains that hold at least that share of a notice.

    ``found`` has (place in the text, place in the notice, words) in the order of the text. Each
    match joins the best chain that ends at most MAX_GAP words before it, in both orders; words
    that overlap count once.
    """
    ordered = sorted(found)
    starts = [m[0] for m in ordered]
    best: list[tuple[int, int]] = []  # words covered by the best chain to each match, its predecessor
    for i, (at, place, length) in enumerate(ordered):
        top = (length, -1)
        for j in range(bisect_right(starts, at - MAX_GAP - size), i):
            b_at, b_place, b_length = ordered[j]
            overlap = max(0, b_at + b_length - at, b_place + b_length - place)
            gap = max(at - b_at - b_length, place - b_place - b_length)
            if b_at < at and b_place < place and overlap < length and gap <= MAX_GAP:
                top = max(top, (best[j][0] + length - overlap, j))
        best.append(top)
    spans, used = [], set()
    for i in sorted(range(len(ordered)), key=lambda k: (-best[k][0], k)):
        if best[i][0] < least * size:
            break
        path, k = [], i
        while k >= 0 and k not in used:
            path.append(k)
            k = best[k][1]
        if k < 0:  # no part of it belongs to a better chain
            held = {at for m in path for at in range(ordered[m][0], ordered[m][0] + ordered[m][2])}
            spans.append((ordered[path[-1]][0], ordered[i][0] + ordered[i][2] - 1, min(1.0, best[i][0] / size), held))
        used.update(path)
    return spans


def licences_of(text: Column, scanner: Scanner | None = None) -> Column:
    """Struct of base counts, labels, score and covered spans of every text."""
    scanner = scanner or Scanner()

    @F.arrow_udf(RESULT)
    def scanned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            rows: list[dict] = []
            for part in chunks(column):
                rows += scanner.scan(column.slice(part.start, part.stop - part.start))
            yield pa.array(rows, RESULT_TYPE)

    return scanned(text)


RESULT_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        (
            "spans",
            pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()),
                        ("first_word", pa.int64()),
                        ("last_word", pa.int64()),
                        ("cover", pa.float64()),
                    ]
                )
            ),
        ),
    ]
)


def scan(documents: DataFrame, name: str = "licences", scanner: Scanner | None = None) -> DataFrame:
    """All input columns and the struct of what was found."""
    return documents.withColumn(name, licences_of(F.col("text"), scanner))
