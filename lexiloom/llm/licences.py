"""Licence scans by a generalised suffix automaton of licence words.

All templates (short phrases and passages of licences) go into one suffix automaton over words. A text is streamed
through it word by word, which gives its matching statistics: at each word, the longest run of words ending there that
stands somewhere in a template. A run that cannot be continued is a longest match; matches of at least ``MATCH`` words
are chained where they follow each other in the text and in one template, and the words a chain covers of its template
make it a span if they are a share of at least ``SHARE``. Phrases are templates that must stand whole: each place is
found where the phrase is a suffix of the match, without looking at the text again.

The automaton grows with the templates only and is built once per Python worker. Texts never leave their rows, so
nothing is shuffled and a file is one task's work however hot its source is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import documents_of, slices, texts_of
from lexiloom.llm.ranked_search import terms_of

MATCH = 4  # words of a match that may belong to a chain
GAP = 24  # words of a text, and of a template, that may stand between two matches of a chain
SHARE = 0.5  # of a template's words, from which a chain is a span

# Phrases that name a licence, and the label each gives.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Labels and passages of public licence texts and of the notices that point to them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
            "and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
               "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
            "version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
                  "use, compile, sell, or distribute this software"),
    ("cc", "This work is licensed under a Creative Commons Attribution"),
    ("cc", "Licensed under CC BY 4.0."),
    ("cc", "Licensed under CC BY-SA 4.0."),
    ("cc", "Licensed under CC BY-NC 4.0."),
)

SPANS = "array<struct<label: string, first_word: long, last_word: long, covered: long, share: double, whole: boolean>>"


class Automaton:
    """Suffix automaton of several word sequences; each state lists where its words end in them."""

    def __init__(self, sequences: Sequence[Sequence[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, words in enumerate(sequences):
            last = 0
            for place, word in enumerate(words):
                last = self._extended(last, word)
                self.ends[last].add((number, place))
        # Where a state's words end, its suffixes end too.
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state] if self.link[state] else set()

    def _state(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _extended(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, word, known)
        state, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            after = self.next[at][word]
            self.link[state] = after if self.length[after] == self.length[at] + 1 else self._split(at, word, after)
        return state

    def _split(self, at: int, word: bytes, state: int) -> int:
        """A state of its own for those suffixes of ``state`` that extend ``at`` by the word."""
        own = self._state(self.length[at] + 1, dict(self.next[state]), self.link[state])
        self.link[state] = own
        while at >= 0 and self.next[at].get(word) == state:
            self.next[at][word] = own
            at = self.link[at]
        return own

    def statistics(self, words: Sequence[bytes]) -> Iterator[tuple[int, int]]:
        """For each word, the state and length of the longest run ending there that stands in a sequence."""
        edges, link, lengths = self.next, self.link, self.length
        start, state, length = edges[0], 0, 0
        for word in words:
            after = edges[state].get(word) if state else start.get(word)
            if after is None and state:
                while state and after is None:
                    state = link[state]
                    after = edges[state].get(word)
                length = lengths[state]
            if after is None:
                length = 0
            else:
                state, length = after, length + 1
            yield state, length


class Scanner:
    """Licence spans of texts, for phrases that must stand whole and templates that may be covered in part."""

    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]):
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        self.sequences = [terms_of(text.encode()) for text, _ in phrases] + [terms_of(text.encode()) for _, text in templates]
        if not all(self.sequences):
            raise ValueError("a phrase or template has no words")
        self.phrases = len(phrases)
        self.automaton = Automaton(self.sequences)
        a = self.automaton
        # The phrases that are suffixes of a state's longest run: its own and those of the state it links to.
        self.whole: list[list[int]] = [[] for _ in a.link]
        for p, words in enumerate(self.sequences[:self.phrases]):
            self.whole[list(a.statistics(words))[-1][0]].append(p)
        for state in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            self.whole[state] = self.whole[state] + self.whole[a.link[state]]
        # Places in templates only, for the chains.
        self.places = [sorted((t, e) for t, e in ends if t >= self.phrases) for ends in a.ends]

    def hits(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Places (phrase, first, last) of whole phrases, and longest matches (first, last, state) of templates."""
        places, matches = [], []
        whole, sizes = self.whole, [len(s) for s in self.sequences]
        before, longest = 0, 0
        for i, (state, length) in enumerate(self.automaton.statistics(words)):
            if length <= longest and longest >= MATCH:
                matches.append((i - longest, i - 1, before))
            before, longest = state, length
            if length:
                for p in whole[state]:
                    if sizes[p] <= length:
                        places.append((p, i - sizes[p] + 1, i))
        if longest >= MATCH:
            matches.append((len(words) - longest, len(words) - 1, before))
        return places, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first, last, covered): matches that follow each other in the text and in one template.

        Each match joins the chain before it that covers most; a match that overlaps its predecessor in the text or in
        the template adds only the words after both.
        """
        by_template: dict[int, list[tuple[int, int, int, int]]] = {}
        for first, last, state in matches:
            for template, end in self.places[state]:
                by_template.setdefault(template, []).append((first, last, end - (last - first), end))
        found = []
        for template, own in by_template.items():
            best: list[tuple[int, int, int]] = []  # covered, first word of the chain, predecessor
            continued: set[int] = set()
            start = 0
            for i, (first, last, begin, end) in enumerate(own):
                while own[start][1] < first - GAP:
                    start += 1
                covered, origin, via = last - first + 1, first, -1
                for j in range(start, i):
                    _, last_j, _, end_j = own[j]
                    shared = max(last_j - first + 1, end_j - begin + 1, 0)
                    if last_j < last and end_j < end and begin - end_j <= GAP and best[j][0] + last - first + 1 - shared > covered:
                        covered, origin, via = best[j][0] + last - first + 1 - shared, best[j][1], j
                best.append((covered, origin, via))
                continued.add(via)
            # A chain ends where nothing goes on from it; of chains from one start the fullest stands.
            ends: dict[int, tuple[int, int]] = {}
            for i, (covered, origin, _) in enumerate(best):
                if i not in continued and covered > ends.get(origin, (0, 0))[0]:
                    ends[origin] = (covered, own[i][1])
            found += [(template, origin, last, covered) for origin, (covered, last) in ends.items()]
        return found

    def spans(self, words: Sequence[bytes]) -> list[tuple]:
        """(label, first word, last word, covered words, covered share, whether a phrase), by place and label."""
        places, matches = self.hits(words)
        found = {(self.labels[p], first, last, last - first + 1, 1.0, True) for p, first, last in places}
        for template, first, last, covered in self.chains(matches):
            share = covered / len(self.sequences[template])
            if share >= SHARE:
                found.add((self.labels[template], first, last, covered, share, False))
        return sorted(found, key=lambda s: (s[1], s[2], s[0], s[5], s[3], s[4]))


@lru_cache(maxsize=4)
def scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(phrases, templates)


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, spans): every row's licence spans by place, as positions of words from 0.

    A span has its label, first and last word, how many words of its template it covers and which share, and whether it
    is a whole phrase. A null or empty text has no words and no spans. Rows are scanned one by one: repeated rows and
    null ids stay, and other columns are ignored. An empty table gives no rows.
    """
    phrases, templates = tuple(map(tuple, phrases)), tuple(map(tuple, templates))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(phrases, templates)
        names = ["label", "first_word", "last_word", "covered", "share", "whole"]
        kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())))))
        for batch in slices(batches, "text"):
            words = [terms_of(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(list(map(len, words)), pa.int64()),
                pa.array([[dict(zip(names, s)) for s in own.spans(w)] for w in words], kind)], ["doc_id", "n_words", "spans"])

    return documents_of(docs).mapInArrow(search, f"doc_id long, n_words long, spans {SPANS}")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts, places and labels of each row's spans; the score is the largest share of a template that is covered."""
    base = F.filter("spans", lambda s: s["whole"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"))
