"""Licence scans: a generalised suffix automaton over the tokens of licence templates.

The automaton of all templates is built once per worker. A document's words are streamed through it; the matching
statistics (length of the longest template substring ending at each word) give maximal matches, and matches of at least
MIN_MATCH words are chained, in template order and over gaps of at most MAX_GAP words, into spans with the share of the
template they cover. Phrases are templates too: one stands at a word exactly if the state reached there has the
phrase's state on its suffix-link path, so all places of all phrases come from the same pass.

Spans compete: a span claims its template's label if it covers enough of it (LABEL_COVER; SHORT_COVER of a short template,
whose words are common ones) and at least half of its words are not those of spans of other labels that cover more. So a
licence that shares paragraphs with another is told by the words of its own.

Defined results: null or empty text has no words, labels or span and score 0; texts of any length are scanned whole; of
spans that cover equally many words, that of the larger share, then of the earlier place, then of the earlier template
claims first; repeated rows give equal rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.common import map_arrow, per_row, read_documents, text_bytes

MIN_MATCH = 4
MAX_GAP = 12
LABEL_COVER, SHORT_COVER = 0.5, 0.8
SHORT_WORDS = 40

#: Fixed by the query's contract.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAME = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_WARRANTY = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_BSD_LIABILITY = "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"

TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        f"{_WARRANTY} in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "released under the mit license",
        "licensed under the mit license",
    ],
    "apache": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license version 2 0",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program if not see",
        "this work is licensed under the gnu general public license version 3",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        "you should have received a copy of the gnu lesser general public license along with this library if not see",
    ],
    "agpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details",
        "you should have received a copy of the gnu affero general public license along with this program if not see",
    ],
    "bsd": [_BSD, f"{_BSD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_WARRANTY} {_BSD_LIABILITY}", f"{_BSD} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAME} {_BSD_WARRANTY} {_BSD_LIABILITY}"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    ],
    "boost": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
        "distributed under the boost software license version 1 0",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"],
    "epl": [
        "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ],
    "wtfpl": ["do what the fuck you want to public license terms and conditions for copying distribution and modification", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "cc": ["this work is licensed under a creative commons attribution", "this work is licensed under the creative commons attribution", "licensed under the creative commons zero universal public domain dedication"],
    "proprietary": ["all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"],
}

WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_spans long, covered_words long"


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences; states know an end place in each template they occur in."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, token: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: bytes) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def add(self, tokens: list[bytes]) -> None:
        state = 0
        for token in tokens:
            state = self._extend(state, token)

    def mark(self, template: int, tokens: list[bytes]) -> None:
        """Note the first end place of ``template`` on every state that one of its prefixes' suffixes is in."""
        state = 0
        for end, token in enumerate(tokens, 1):
            state = self.next[state][token]
            at = state
            while at > 0 and template not in self.ends[at]:
                self.ends[at][template] = end
                at = self.link[at]

    def locate(self, tokens: list[bytes]) -> int:
        state = 0
        for token in tokens:
            state = self.next[state][token]
        return state


class LicenceScanner:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.labels, self.sizes = [], []
        self.automaton, sequences = SuffixAutomaton(), []
        for label, texts in templates.items():
            for text in texts:
                sequences.append(text.encode().split())
                self.labels.append(label)
                self.sizes.append(len(sequences[-1]))
        split = {p: p.encode().split() for p in phrases}
        for tokens in [*sequences, *split.values()]:
            self.automaton.add(tokens)
        for i, tokens in enumerate(sequences):
            self.automaton.mark(i, tokens)
        self.vocabulary = {t for tokens in [*sequences, *split.values()] for t in tokens}
        at = {self.automaton.locate(tokens): (len(tokens), label) for p, label in phrases.items() for tokens in [split[p]]}
        # phrases that end wherever a state is reached: those of the states on its suffix-link path
        self.phrases: list[list[tuple[int, str]]] = []
        for state in range(len(self.automaton.next)):
            own = []
            while state > 0:
                if state in at:
                    own.append(at[state])
                state = self.automaton.link[state]
            self.phrases.append(own)

    def stream(self, words: list[bytes]) -> tuple[list, list]:
        """Phrase places (start, label) and maximal matches (end, length, state) from the matching statistics."""
        nxt, link, lengths, phrases, vocabulary = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases, self.vocabulary
        places, matches = [], []
        state = length = 0
        before = -2
        for i in [i for i, w in enumerate(words) if w in vocabulary]:
            if i != before + 1:
                if length >= MIN_MATCH:
                    matches.append((before + 1, length, state))
                state = length = 0
            word, before = words[i], i
            if word in nxt[state]:
                state, length = nxt[state][word], length + 1
            else:
                if length >= MIN_MATCH:
                    matches.append((i, length, state))
                while state != -1 and word not in nxt[state]:
                    state = link[state]
                if state == -1:
                    state = length = 0
                else:
                    length, state = lengths[state] + 1, nxt[state][word]
            for size, label in phrases[state]:
                if size <= length:
                    places.append((i - size + 1, label))
        if length >= MIN_MATCH:
            matches.append((before + 1, length, state))
        return places, matches

    def spans(self, matches: list) -> list[tuple[int, int, int, list]]:
        """(template, words covered, end in the template, matched ranges of words) of chained matches."""
        open_chains: dict[int, list] = {}
        done = []
        for end, length, state in matches:
            for template, at in self.automaton.ends[state].items():
                chain = open_chains.get(template)
                start = end - length
                if chain and start - chain[2][-1][1] <= MAX_GAP and at > chain[1]:
                    fresh = min(length, end - chain[2][-1][1], at - chain[1])
                    chain[0] += fresh
                    chain[1] = at
                    chain[2].append((end - fresh, end))
                    continue
                if chain:
                    done.append((template, *chain))
                open_chains[template] = [length, at, [(start, end)]]
        return done + [(t, *c) for t, c in open_chains.items()]

    def claims(self, spans: list) -> list[tuple[str, float, list]]:
        """(label, cover, ranges) of the spans that win their words."""
        order = sorted(spans, key=lambda s: (-s[1], -s[1] / self.sizes[s[0]], s[3][0][0], s[0]))
        taken: dict[int, str] = {}
        out = []
        for template, covered, _, ranges in order:
            size, label = self.sizes[template], self.labels[template]
            if covered < (SHORT_COVER if size < SHORT_WORDS else LABEL_COVER) * size:
                continue
            words = [w for a, b in ranges for w in range(a, b)]
            if 2 * sum(taken.get(w, label) == label for w in words) >= len(words):
                out.append((label, covered / size, ranges))
                for w in words:
                    taken.setdefault(w, label)
        return out

    def scan(self, text: bytes) -> dict:
        words = text.translate(WORDS).split()
        places, matches = self.stream(words)
        spans = self.spans(matches)
        best = max((covered / self.sizes[t] for t, covered, _, _ in spans), default=0.0)
        return {"n_words": len(words), "places": places, "spans": self.claims(spans), "best": min(1.0, best)}


@functools.lru_cache(maxsize=1)
def scanner() -> LicenceScanner:
    """One scanner for each worker process."""
    return LicenceScanner(TEMPLATES, BASE_PHRASES)


def scan_row(doc_id: int | None, text: bytes) -> tuple:
    got = scanner().scan(text)
    places, claimed = got["places"], got["spans"]
    starts = [at for at, _ in places]
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(label for label, _, _ in claimed)})
    covered = {w for _, _, ranges in claimed for w in range(ranges[0][0], ranges[-1][1])}
    score = max(got["best"], 0.5 if base else 0.0)
    return doc_id, got["n_words"], len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), float(score), len(claimed), len(covered)


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row of SCAN for every row of ``docs`` (columns doc_id and text); the texts are read once, without a shuffle."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), per_row(scan_row, SCAN), SCAN)


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read_documents(spark, sf_dir))
