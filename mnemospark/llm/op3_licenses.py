"""Licence scan by a generalised suffix automaton of licence tokens.

The automaton holds all factors of the templates below. A text's words are streamed through it once;
every word gets the longest factor that ends at it (matching statistics). Where a statistic covers a
whole phrase, the phrase stands there. Maximal matches of ``LEAST`` words and more are chained, in
order of place in both text and template, into spans; a template of which a chain covers ``COVERED``
gives its label. Only words that occur in templates are looked at one by one.

Defined cases: null or empty text has no words and score 0; a template cut or edited is found by what
is left of it; repeated rows are rows of their own; no rows, no result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import pieces
from mnemospark.llm.suffix_automaton import SuffixAutomaton

LEAST, COVERED, GAP = 4, 0.5, 12
#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices as licences ask for them, by label.
TEMPLATES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("mit", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("copyright", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]
#: Bytes that are no part of a word, as blanks; A-Z lower-cased.
_WORDS = bytes(32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


@dataclass
class Scan:
    n_words: int
    base: list[tuple[int, str]] = field(default_factory=list)  # place, label
    spans: list[tuple[int, int, str, float]] = field(default_factory=list)  # first word, end, label, share of the template


class Licences:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> None:
        self.numbers: dict[bytes, int] = {}
        self.auto, self.labels = SuffixAutomaton(), list(phrases.values())
        number = lambda text: [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)]
        self.templates = [(label, number(t)) for label, t in templates]
        phrase = [number(p) for p in phrases]
        for k, words in enumerate([w for _, w in self.templates] + phrase):
            self.auto.add(words, k)
        for k, words in enumerate(phrase):
            self.auto.mark(words, k)
        self.auto.finish()
        #: Where in templates a state's factors end: all places, for chaining.
        self.ends: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.templates):
            for i, (s, _) in enumerate(self.auto.walk(words)):
                while s > 0:
                    self.ends.setdefault(s, []).append((k, i + 1))
                    s = self.auto.link[s]

    def scan(self, text: str | None) -> Scan:
        words = words_of(text)
        out = Scan(len(words))
        known = self.numbers.keys() & set(words)
        if not known:
            return out
        get = self.numbers.get
        numbers = [get(w, -1) for w in words]
        runs, start = [], None
        for i, w in enumerate(numbers):
            if w >= 0:
                if start is None:
                    start = i
            elif start is not None:
                if i - start > 1:
                    runs.append((start, i))
                start = None
        if start is not None and len(words) - start > 1:
            runs.append((start, len(words)))
        matches: list[tuple[int, int, int]] = []  # first word, end, state
        for a, b in runs:
            path = self.auto.walk(numbers[a:b])
            for i, (s, n) in enumerate(path):
                for mark, size in self.auto.marked[s]:
                    if size <= n:
                        out.base.append((a + i + 1 - size, self.labels[mark]))
                if n >= LEAST and (i + 1 == len(path) or path[i + 1][1] <= n):
                    matches.append((a + i + 1 - n, a + i + 1, s))
        out.base.sort()
        out.spans = self.chain(matches)
        return out

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Chains of matches that follow one another in the text and in a template, by template; those that cover enough."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for first, end, s in matches:
            for k, at in self.ends.get(s, ()):
                by.setdefault(k, []).append((first, end, at))
        spans = []
        for k, found in by.items():
            label, template = self.templates[k]
            open_: list[list[int]] = []  # first word, end, template end, words covered
            for first, end, at in sorted(found):
                best = max((c for c in open_ if c[1] < end and c[2] < at and first - c[1] <= GAP), key=lambda c: c[3], default=None)
                gain = end - first if best is None else min(end - max(first, best[1]), at - best[2])
                if best is None:
                    open_.append([first, end, at, gain])
                else:
                    best[1], best[2], best[3] = end, at, best[3] + gain
            spans += [(c[0], c[1], label, min(1.0, c[3] / len(template))) for c in open_ if c[3] >= COVERED * len(template)]
        return sorted(set(spans))


_licences: list[Licences] = []


def licences() -> Licences:
    if not _licences:
        _licences.append(Licences())
    return _licences[0]


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (first word, end, label, share) of every row."""

    def run(batches):
        lic = licences()
        for b in pieces(batches, "text"):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = lic.scan(text)
                base = {label for _, label in s.base}
                share = max((x for *_, x in s.spans), default=0.0)
                score = max(share, 0.9 if base else 0.0)
                at = [p for p, _ in s.base]
                found = [{"first": a, "end": e, "label": k, "share": x} for a, e, k, x in s.spans]
                rows.append((doc_id, s.n_words, len(s.base), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(base | {k for *_, k, _ in s.spans})), score, found))
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, _NAMES)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first: long, end: long, label: string, share: double>>")


_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())])
_KINDS = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(_SPAN)]


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
