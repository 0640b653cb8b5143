"""Licence scans by matching statistics over a generalised suffix automaton."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Public licence notices, as templates.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    ),
    "lgpl": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced without permission",
}
#: A match of fewer words is no evidence; a template whose chained matches cover this share of its words is found.
MIN_MATCH, COVER = 3, 0.75

#: A-Z become lower case, other ASCII but digits and letters a space; bytes above 0x7F stay.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(body: bytes | None) -> list[bytes]:
    return body.translate(_BYTES).split() if body else []


class Automaton:
    """Generalised suffix automaton of word sequences. State 0 is the root."""

    def __init__(self, texts: list[list[int]]) -> None:
        self.texts = texts
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [(-1, -1)]
        for t, text in enumerate(texts):
            last = 0
            for at, word in enumerate(text):
                last = self._extend(last, word, (t, at))
        by_length = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        self.owners: list[set[tuple[int, int]]] = [set() for _ in self.length]
        for t, text in enumerate(texts):
            state = 0
            for at, word in enumerate(text):
                state = self.next[state][word]
                self.owners[state].add((t, at))
        for s in by_length:
            if self.link[s] > 0:
                self.owners[self.link[s]] |= self.owners[s]

    def _new(self, length: int, link: int, first: tuple[int, int], edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], self.first[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int, where: tuple[int, int]) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        state, p = self._new(self.length[last] + 1, 0, where, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) after each word: the longest suffix read so far that occurs in a text."""
        state = size = 0
        step, link, length = self.next, self.link, self.length
        for word in words:
            while state and word not in step[state]:
                state = link[state]
                size = length[state]
            if word in step[state]:
                state = step[state][word]
                size += 1
            else:
                state = size = 0
            yield state, size


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> None:
        texts = [(words_of(p.encode()), label, True) for p, label in phrases.items()]
        texts += [(words_of(t.encode()), label, False) for label, t in templates.items()]
        self.ids: dict[bytes, int] = {}
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in ws] for ws, _, _ in texts]
        self.labels = [label for _, label, _ in texts]
        self.sizes = [len(c) for c in coded]
        self.base = [b for _, _, b in texts]
        self.machine = Automaton(coded)
        # a phrase ends in the state of its whole text and in every longer match that has this state among its suffix links
        ends: list[list[tuple[int, int]]] = [[] for _ in self.machine.length]
        for t, code in enumerate(coded):
            if self.base[t] and code:
                state = 0
                for word in code:
                    state = self.machine.next[state][word]
                ends[state].append((self.sizes[t], t))
        for s in sorted(range(1, len(ends)), key=self.machine.length.__getitem__):
            ends[s] += ends[self.machine.link[s]]
        self.ends = ends
        self.shortest = min([MIN_MATCH, *(n for n, b in zip(self.sizes, self.base, strict=True) if b)])

    def scan(self, body: bytes | None) -> tuple[int, list[tuple[int, int]], dict[int, list[tuple[int, int, int]]]]:
        """(words, base places as (start, text), matches of each template as (start, template start, length))."""
        words = words_of(body)
        codes = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0])).astype(np.int8)))
        places: list[tuple[int, int]] = []
        found: dict[int, list[tuple[int, int, int]]] = {}
        machine = self.machine
        for lo, hi in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if hi - lo < self.shortest:
                continue
            was = (0, 0)
            for at, (state, size) in enumerate(machine.statistics(codes[lo:hi].tolist()), lo):
                for n, t in self.ends[state]:
                    if size >= n:
                        places.append((at - n + 1, t))
                if size <= was[1] and was[1] >= MIN_MATCH:
                    self._note(found, at, *was)
                was = (state, size)
            if was[1] >= MIN_MATCH:
                self._note(found, hi, *was)
        return len(words), places, found

    def _note(self, found: dict, end: int, state: int, size: int) -> None:
        for t, at in self.machine.owners[state]:
            if not self.base[t]:
                found.setdefault(t, []).append((end - size, at - size + 1, size))

    def covered(self, t: int, matches: list[tuple[int, int, int]]) -> float:
        """The largest share of template t that one chain covers: matches in order on both sides, near each other."""
        matches = sorted(set(matches))
        reach = 2 * self.sizes[t]
        best: list[int] = []
        lo = 0
        for k, (s, p, n) in enumerate(matches):
            while matches[lo][0] + reach < s:
                lo += 1
            gain = n
            for j in range(lo, k):
                s0, p0, n0 = matches[j]
                over = max(0, s0 + n0 - s, p0 + n0 - p)
                if s0 < s and p0 < p and over < n:
                    gain = max(gain, best[j] + n - over)
            best.append(gain)
        return max(best) / self.sizes[t]


@cache
def scanner() -> Scanner:
    return Scanner()


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = scanner()
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for body in batch.column(1):
            n, places, found = own.scan(body.as_py())
            shares = {t: own.covered(t, m) for t, m in found.items()}
            base = sorted({own.labels[t] for _, t in places})
            more = {own.labels[t] for t, share in shares.items() if share >= COVER}
            starts = [s for s, _ in places]
            score = 1.0 if places else max(shares.values(), default=0.0)
            row = (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(more | set(base))), score)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs (doc_id, text).

    Words are runs of ASCII letters and digits and of characters above U+007F, with A-Z lower-cased. Each text is streamed once
    through the automaton of all phrases and templates, which tells after every word the longest match that ends there.
    A phrase is found wherever it is that match or, along the suffix links, a tail of it. Maximal matches of MIN_MATCH words or more
    are chained by template, in order on both sides and at most twice the template's length apart; a template is found
    if a chain covers COVER of its words. score is 1 with a base phrase, else the largest share covered. Null and empty
    texts have no words, no labels and score 0; null ids and repeated rows keep their rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("body")).mapInArrow(
        _scan_batches,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
