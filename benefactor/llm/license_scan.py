"""License scans: templates with optional and replaceable regions, compiled to token automata.

A template is a line of words with two kinds of markup: `[[ ... ]]` is optional wording and
`<<n>>` a replaceable region of up to n words. It becomes an automaton over word tokens; a place
in a text is accepted when the words there run through it, that is, when all mandatory wording
stands there exactly. Automata run from places of their first word only.

Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z in lower case.

Edge cases: a null or empty text has no words, no labels and score 0; repeated rows are answered
alike; overlapping accepted places of one template count as often as they start.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from benefactor.llm import hashing
from benefactor.llm.common import pick, utf8

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_MARK = re.compile(r"\[\[|\]\]|<<\d+>>|[^\x00-\x20\[\]<>]+")
_UPPER = {c: c + 32 for c in range(65, 91)}

#: Base phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates of license statements and texts (fixed wording of the public licenses).
TEMPLATES = {
    "mit-statement": "[[this work is]] [[released]] [[licensed]] under the [[terms of the]] mit license",
    "apache-2.0": "licensed under the apache license [[version]] 2 0 [[the license]]",
    "gpl-2.0": "gnu general public license [[as published by the free software foundation either]] version 2 [[of the license]]",
    "gpl-3.0": "gnu general public license [[as published by the free software foundation either]] version 3 [[of the license]]",
    "cc-by-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by 4 0",
    "cc-by-nc-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by sa 4 0",
    "gpl-notice": (
        "is free software [[you can redistribute it and or modify]] it under the terms of the gnu general public license as published by the free software foundation "
        "[[either]] version <<1>> [[of the license or at your option any later version]] <<12>> is distributed in the hope that it will be useful "
        "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"
    ),
    "lgpl-notice": (
        "under the terms of the gnu [[lesser]] [[library]] general public license as published by the free software foundation "
        "[[either]] version <<2>> [[of the license or at your option any later version]]"
    ),
    "agpl-3.0": "gnu affero general public license [[as published by the free software foundation either]] version 3 [[of the license]]",
    "mpl-2.0-header": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at [[http]] [[https]] [[www]] mozilla org mpl 2 0"
    ),
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions"
    ),
    "unlicense-text": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
    ),
    "boost-1.0-text": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"
    ),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall <<12>> be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "isc-text": (
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies"
    ),
    "bsd-2-clause-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution"
    ),
    "bsd-3-clause-text": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution [[3]] neither the name of <<12>> nor the names of its contributors "
        "may be used to endorse or promote products derived from this software without specific prior written permission"
    ),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at [[http www apache org licenses license 2 0]] <<8>> unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
}


class TokenAutomaton:
    """States are places between the tokens of a template, kept as the bits of an integer."""

    def __init__(self, template: str):
        step: dict[str, int] = {}  # word -> states that it leads on from
        skip: list[tuple[int, int]] = []  # optional region: from state, to state
        open_, free, state, needed = [], 0, 0, []
        for mark in _MARK.findall(template):
            if mark == "[[":
                open_.append(state)
            elif mark == "]]":
                skip.append((open_.pop(), state))
            elif mark.startswith("<<"):
                begin = state
                for _ in range(int(mark[2:-2])):
                    free |= 1 << state
                    state += 1
                skip += [(s, state) for s in range(begin, state)]
            else:
                step[mark] = step.get(mark, 0) | 1 << state
                state += 1
                if not open_:
                    needed.append(mark)
        if open_:
            raise ValueError("an optional region is not closed")
        self._step, self._free, self._skip, self._end = step, free, sorted(skip), 1 << state
        self.start = self._closed(1)
        if self.start & self._end:
            raise ValueError("a template needs mandatory words")
        self.firsts = {w for w, s in step.items() if s & self.start}
        if not needed:
            raise ValueError("a template needs a mandatory word")
        self.anchor = max(needed, key=len)  # a text without it can't match
        self._next: dict[tuple[int, str], int] = {}

    def _closed(self, states: int) -> int:
        while True:
            more = states
            for a, b in self._skip:
                if more >> a & 1:
                    more |= 1 << b
            if more == states:
                return states
            states = more

    def _advance(self, states: int, word: str) -> int:
        known = word if word in self._step else ""
        key = (states, known)
        if key not in self._next:  # the subset construction, as far as texts ask for it
            self._next[key] = self._closed((states & (self._step.get(known, 0) | self._free)) << 1)
        return self._next[key]

    def accepts_at(self, words: list[str], place: int) -> int:
        """The end of the longest accepted run from `place`, or -1."""
        states, best = self.start, -1
        for i in range(place, len(words)):
            states = self._advance(states, words[i])
            if not states:
                break
            if states & self._end:
                best = i + 1
        return best


@dataclass
class LicenseScanner:
    """Compiled templates; `scan` gives (label, first word, end) of each accepted place."""

    templates: dict[str, str]

    def __post_init__(self):
        self._automata = {label: TokenAutomaton(t) for label, t in self.templates.items()}
        self.anchors = sorted({a.anchor.encode() for a in self._automata.values()})
        self._by_first: dict[str, list[str]] = {}
        for label, a in self._automata.items():
            for w in a.firsts:
                self._by_first.setdefault(w, []).append(label)

    def scan(self, words: list[str]) -> list[tuple[str, int, int]]:
        found, by_first = [], self._by_first
        for place, word in enumerate(words):
            for label in by_first.get(word, ()):
                end = self._automata[label].accepts_at(words, place)
                if end >= 0:
                    found.append((label, place, end))
        return found


def license_digest(docs: DataFrame) -> DataFrame:
    """Base places and labels of every whole text, and the labels of the templates.

    The score is the share of the text's words that accepted places cover.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches):
        scanner = LicenseScanner({f"base {label}": phrase for phrase, label in PHRASES.items()} | TEMPLATES)
        anchors = scanner.anchors  # each template's longest mandatory word: a text without any matches nothing
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            rows = []
            for a, b in hashing.batches(bounds):
                part = data[bounds[a] : bounds[b]]
                own = bounds[a : b + 1] - bounds[a]
                lower = hashing.LOWER[part]
                word = ~hashing.NO_ALNUM[lower]
                first = word.copy()
                first[1:] &= ~word[:-1]
                inner = own[own < len(part)]
                first[inner] = word[inner]
                before = np.concatenate([[0], np.cumsum(first)])
                counts = before[own[1:]] - before[own[:-1]]
                whole = lower.tobytes()
                for i in range(b - a):
                    text, n = whole[own[i] : own[i + 1]], int(counts[i])
                    if not any(x in text for x in anchors):
                        rows.append((n, 0, None, None, "", "", 0.0))
                        continue
                    words = _WORD.findall(text.decode())
                    found = scanner.scan(words)
                    base = [f for f in found if f[0].startswith("base ")]
                    own_labels = sorted({f[0][5:] for f in base})
                    labels = sorted({f[0] for f in found if not f[0].startswith("base ")} | set(own_labels))
                    covered = len({k for _, s, e in found for k in range(s, e)})
                    places = [f[1] for f in base]
                    rows.append((n, len(base), min(places, default=None), max(places, default=None), ",".join(own_labels), ",".join(labels), covered / n if n else 0.0))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [p.split()[0] for p in schema.split(", ")])

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)


def scan_places(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """doc_id, label, first_word and end of every accepted place, for templates of the caller's."""

    def run(batches):
        scanner = LicenseScanner(templates)
        for pdf in batches:
            rows = [
                (doc_id, *f) for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True) for f in scanner.scan(_WORD.findall((text or "").translate(_UPPER)))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "first_word", "end"])

    return pick(docs, "doc_id", "text").mapInPandas(run, "doc_id long, label string, first_word long, end long")
