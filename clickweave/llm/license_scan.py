"""Licence scans with a generalised suffix automaton of licence texts.

The automaton holds the words of all templates and of the base phrases. A document is
streamed through it once: after every word it is known how long the longest run of words
is that ends there and occurs in some template (the matching statistics). A base phrase is
found wherever its own state is on the suffix path of that run; runs of at least
``LEAST_RUN`` words that cannot be extended are matches, and matches whose places in a
template go in the same direction, at most ``GAP`` words apart, are chained so that as many words
as possible of the template are covered. Every chain that covers ``LEAST_COVER`` of a template is a
span and gives its label, so a text with two notices has two spans; where none does, the best one is
a span without a label.

Words that occur in no template reset the automaton, so they are skipped without a step;
one pass over the corpus, no shuffle. The automaton has at most two states a template
word; it goes to the tasks as it is.

Defined results: a null or wordless text has no words, no places, no labels and score 0.
Every row is judged by its own text, so repeated rows, ties and null ids are no special case.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from clickweave.llm.common import plain_words, utf8

# Phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wordings of public licence notices.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version"
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation"
    ),
    "agpl": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
    "all-rights-reserved": "All rights reserved",
}

LEAST_RUN = 3
LEAST_COVER = 0.6
#: Words between two matches of a chain.
GAP = 20

FOUND = (
    "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: array<string>, "
    "labels: array<string>, score: double, "
    "spans: array<struct<label: string, start: bigint, stop: bigint, cover: double>>>"
)
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())])
_FOUND = pa.struct(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
     ("spans", pa.list_(_SPAN))]
)


@dataclass
class Automaton:
    """Generalised suffix automaton; state 0 is the empty run."""

    next: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    #: Per state the (template, end) places of its runs, those of longer runs included.
    places: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, size: int, link: int, step: dict[bytes, int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.size.append(size)
        self.places.append(set())
        return len(self.size) - 1

    def _clone(self, p: int, q: int, word: bytes) -> int:
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, q, word)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, word)
        return new

    def add(self, words: list[bytes]) -> None:
        state = 0
        for word in words:
            state = self._extend(state, word)

    def locate(self, template: int, words: list[bytes]) -> None:
        """Notes the places of a template's runs; after all templates are added."""
        state = 0
        for i, word in enumerate(words):
            state = self.next[state][word]
            up = state
            while up > 0:
                self.places[up].add((template, i + 1))
                up = self.link[up]

    def state_of(self, words: list[bytes]) -> int:
        state = 0
        for word in words:
            state = self.next[state][word]
        return state


def chains(found: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """(start, stop, words covered) of the best chains of matches (place in the text, place in the template,
    length; in order) of a template of ``size`` words.

    For every match the best chain that ends with it is found by dynamic programming: it goes on from a
    match that begins earlier in both and ends at most ``GAP`` words before it; words that both have
    count once. Chains are then taken by words covered, each match and place of the text once.
    """
    covered, before, first = [0] * len(found), [-1] * len(found), 0
    for j, (start, at, length) in enumerate(found):
        while found[first][0] + size + GAP < start:
            first += 1
        covered[j] = length
        for i in range(first, j):
            s, t, n = found[i]
            if s < start and t < at and start <= s + n + GAP:
                new = length - max(s + n - start, t + n - at, 0)
                if new > 0 and covered[i] + new > covered[j]:
                    covered[j], before[j] = covered[i] + new, i
    out = []
    for j in sorted(range(len(found)), key=lambda j: (-covered[j], found[j])):
        if out and covered[j] < LEAST_COVER * size:
            break
        start, stop, i = found[j][0], found[j][0] + found[j][2], j
        while i >= 0:
            start, i = found[i][0], before[i]
        if all(stop <= a or b <= start for a, b, _ in out):
            out.append((start, stop, covered[j]))
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]) -> None:
        texts = [(label, plain_words(t.encode())) for label, t in templates.items()]
        bases = [(label, p.encode().split()) for p, label in phrases.items()]
        self.labels = [label for label, _ in texts]
        self.sizes = [len(words) for _, words in texts]
        self.automaton = a = Automaton()
        for _, words in [*texts, *bases]:
            a.add(words)
        for i, (_, words) in enumerate(texts):
            a.locate(i, words)
        #: Per state the base phrases on its suffix path: (length, label).
        own: dict[int, list[tuple[int, str]]] = {}
        for label, words in bases:
            own.setdefault(a.state_of(words), []).append((len(words), label))
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in a.size]
        for state in sorted(range(len(a.size)), key=a.size.__getitem__):
            if state:
                self.phrases[state] = own.get(state, []) + self.phrases[a.link[state]]
        self.vocabulary = frozenset(w for step in a.next for w in step)

    def statistics(self, words: list[bytes]):
        """(end, state, length) after every word that goes on some run of a template."""
        a, vocabulary = self.automaton, self.vocabulary
        step, link, size = a.next, a.link, a.size
        state, length, before = 0, 0, -1
        for i in [i for i, w in enumerate(words) if w in vocabulary]:
            if i != before + 1:
                state, length = 0, 0
            before, word = i, words[i]
            while state and word not in step[state]:
                state = link[state]
                length = size[state]
            state = step[state][word]
            length += 1
            yield i + 1, state, length

    def _chained(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """matches: (end, state, length). Spans of templates that are covered enough."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, state, length in matches:
            for template, at in self.automaton.places[state]:
                if at >= length:
                    by_template.setdefault(template, []).append((end - length, at - length, length))
        spans = []
        for template, found in by_template.items():
            for start, stop, words in chains(sorted(found), self.sizes[template]):
                cover = min(1.0, words / self.sizes[template])
                spans.append({"label": self.labels[template], "start": start, "stop": stop, "cover": cover})
        return sorted(spans, key=lambda s: (s["start"], s["label"]))

    def scan(self, text: bytes) -> dict:
        words = plain_words(text)
        places, base, matches, last = [], set(), [], None
        for now in self.statistics(words):
            end, state, length = now
            for n, label in self.phrases[state]:
                if n <= length:
                    places.append(end - n)
                    base.add(label)
            # A run ends where the next one doesn't contain it.
            if last and (end != last[0] + 1 or length <= last[2]) and last[2] >= LEAST_RUN:
                matches.append(last)
            last = now
        if last and last[2] >= LEAST_RUN:
            matches.append(last)
        spans = self._chained(matches)
        labels = base | {s["label"] for s in spans if s["cover"] >= LEAST_COVER}
        return {
            "n_words": len(words), "n_base": len(places),
            "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": sorted(base), "labels": sorted(labels),
            "score": 1.0 if base else max((s["cover"] for s in spans), default=0.0), "spans": spans,
        }


def licenses(text: Column, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> Column:
    """What a text says about licences: places of base phrases, labels, score, template spans."""
    scanner = Scanner(templates, phrases)

    @F.arrow_udf(FOUND)
    def scan(column: pa.Array) -> pa.Array:
        return pa.array([scanner.scan(t) for t in utf8(column)], _FOUND)

    return scan(text)
