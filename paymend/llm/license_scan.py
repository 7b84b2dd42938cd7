"""Licence scan by matching statistics over a generalised suffix automaton.

The automaton holds all token runs of all licence templates. A file is streamed through it:
after each token the automaton knows the longest run ending there that some template holds.
Runs that end are chained, per template, into covered spans; a template that is covered far
enough gives its label. The short base phrases are templates too; each place where one stands
is counted from the same stream.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from paymend.llm.batches import emit, map_chunks, raw

#: Phrases that count wherever they stand. Fixed values.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices whose spans are looked for: (label, text). Common public licence wording.
TEMPLATES = (
    ("agpl", "GNU Affero General Public License version 3"),
    ("all-rights-reserved", "All rights reserved"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Shortest run that is chained, largest gap in tokens between chained runs, share of a template to be covered.
RUN, GAP, COVER = 3, 8, 0.8
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first:long,last:long,cover:double>>"
)
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])
_OUT = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
)


def tokens(text: bytes | None) -> list[bytes]:
    """Words of A-Z lower-cased text: ASCII letters and digits, and everything beyond ASCII."""
    return (text or b"").translate(_KEEP).split()


@dataclass
class Scan:
    n_words: int
    base: list[tuple[int, str]]
    spans: list[tuple[str, int, int, float]]


class Licences:
    """Generalised suffix automaton of templates and phrases."""

    def __init__(self, templates: Iterable[tuple[str, str]] = TEMPLATES, base: Iterable[tuple[str, str]] = BASE):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.templates = [(label, tokens(text.encode())) for label, text in templates]
        self.phrases = [(label, tokens(text.encode())) for text, label in base]
        for number, (_, words) in enumerate(self.templates + self.phrases):
            state = 0
            for place, word in enumerate(words):
                state = self._extend(state, word)
                self.ends[state].append((number, place))
        self._finish()

    def _new(self, size: int, link: int, moves: dict) -> int:
        self.next.append(dict(moves))
        self.link.append(link)
        self.size.append(size)
        self.ends.append([])
        return len(self.size) - 1

    def _split(self, at: int, word: bytes) -> int:
        """The state for the run of ``at`` and ``word``, cut off from a longer one if need be."""
        to = self.next[at][word]
        if self.size[to] == self.size[at] + 1:
            return to
        copy = self._new(self.size[at] + 1, self.link[to], self.next[to])
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        state, at = self._new(self.size[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            self.link[state] = self._split(at, word)
        return state

    def _finish(self) -> None:
        """Places of a state's runs include those of the longer runs that end in it; phrases that end a run are listed."""
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for state in reversed(order):
            if self.link[state] > 0:
                self.ends[self.link[state]].extend(self.ends[state])
        self.phrase_at: list[list[tuple[int, str]]] = [[] for _ in self.size]
        for label, words in self.phrases:
            state = 0
            for word in words:
                state = self.next[state][word]
            self.phrase_at[state].append((len(words), label))
        for state in order:
            self.phrase_at[state] = self.phrase_at[state] + self.phrase_at[self.link[state]]

    def scan(self, text: bytes | None) -> Scan:
        words = tokens(text)
        start = self.next[0]
        base, runs, state, size, before = [], [], 0, 0, -2
        for i in [i for i, w in enumerate(words) if w in start]:  # other words are in no template
            if i != before + 1 and size:
                self._end(runs, state, size, before)
                state, size = 0, 0
            word = words[i]
            if size and word not in self.next[state]:
                self._end(runs, state, size, before)
                while state and word not in self.next[state]:
                    state = self.link[state]
                    size = self.size[state]
            state, size, before = self.next[state][word], size + 1, i
            for length, label in self.phrase_at[state]:
                if length <= size:
                    base.append((i - length + 1, label))
        if size:
            self._end(runs, state, size, before)
        return Scan(len(words), base, self._chains(runs))

    def _end(self, runs: list, state: int, size: int, last: int) -> None:
        if size >= RUN:
            for number, place in self.ends[state]:
                if number < len(self.templates) and place + 1 >= size:
                    runs.append((number, last - size + 1, last, place - size + 1, place))

    def _chains(self, runs: list) -> list[tuple[str, int, int, float]]:
        """Best chain of runs per template and stretch: both text and template move on, with small gaps."""
        out = set()
        by_template: dict[int, list] = {}
        for number, *run in runs:
            by_template.setdefault(number, []).append(run)
        for number, own in by_template.items():
            label, words = self.templates[number]
            live: list[tuple] = []  # (covered, first, last, template end)
            for first, last, start, stop in sorted(own):
                live = [c for c in live if first - c[2] <= GAP + len(words)]
                best = (stop - start + 1, first, last, stop)
                for covered, head, tail, end in live:
                    # A run may overlap the one before; only what it adds counts.
                    skip = max(0, tail + 1 - first, end + 1 - start)
                    if skip <= stop - start and last > tail and first - tail <= GAP and start - end <= GAP:
                        best = max(best, (covered + stop - start + 1 - skip, head, last, stop))
                live.append(best)
                if best[0] >= COVER * len(words):
                    out.add((label, best[1], best[2], min(1.0, best[0] / len(words))))
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))


_LIBRARY: dict[tuple, Licences] = {}


def _library(templates: tuple, base: tuple) -> Licences:
    if (templates, base) not in _LIBRARY:
        _LIBRARY[templates, base] = Licences(templates, base)
    return _LIBRARY[templates, base]


def scan_licences(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, base: Iterable[tuple[str, str]] = BASE) -> DataFrame:
    """One row per row of ``docs``: places of base phrases, labels, score and covered template spans.

    ``score`` is the best cover of a template, 1 where a base phrase stands, 0 without either.
    Null and empty texts have no words, no places (first_word and last_word null) and empty
    labels. Repeated rows get equal rows; other columns are ignored. The template library goes
    with the task: it is a parameter of the job, not data.
    """
    templates, base = tuple(templates), tuple(base)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        library = _library(templates, base)
        found = [library.scan(t) for t in raw(batch)]
        names = [sorted({label for _, label in s.base}) for s in found]
        return emit(
            _OUT,
            doc_id=batch.column("doc_id"),
            n_words=[s.n_words for s in found],
            n_base=[len(s.base) for s in found],
            first_word=[min((i for i, _ in s.base), default=None) for s in found],
            last_word=[max((i for i, _ in s.base), default=None) for s in found],
            base_labels=[",".join(n) for n in names],
            labels=[",".join(sorted({*n, *(x[0] for x in s.spans)})) for n, s in zip(names, found)],
            score=[1.0 if s.base else max((x[3] for x in s.spans), default=0.0) for s in found],
            spans=[[dict(zip(("label", "first", "last", "cover"), x)) for x in s.spans] for s in found],
        )

    return map_chunks(docs.select("doc_id", "text"), work, _SCHEMA)
