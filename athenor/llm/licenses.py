"""License notices by an exact set-similarity join between text and notice templates.

A template is met by a line, or by a stretch of consecutive words over any lines that is no longer than the template, if the
line or stretch has at least THRESHOLD of the template's distinct words, the template's DECIDING words and none of the RIVALS,
which name another licence. Words that decide stand one after another where they are several.

Lines: words are ordered by the number of lines of the whole corpus that have them, rarest first. A template that a line meets
must have one of its first ``n - ceil(THRESHOLD * n) + 1`` words in the line (prefix filter), the line must be long enough
(length filter), and the words behind that first common word must still suffice on both sides (positional filter); what passes
is counted exactly. Stretches: only a text that has enough of a template's words and what decides is looked at; a window slides
over its words, and of overlapping stretches the best counts. A stretch with a line that meets the template is no second match.

The plain labels come from phrases found word by word anywhere in the text, also across lines; the join adds its own.
Null and empty texts have no words and no labels; null ids and repeated rows stay as they are; an empty table gives no rows. Texts of any
length are read whole; of templates with equal scores all labels count. Columns besides doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenor.llm.common import parts, whole_text

THRESHOLD = Fraction(4, 5)

#: Phrases whose words must stand one after another.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening sentences of public license notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the terms of the MIT license"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-nc", "Content available under CC BY NC 4.0"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]

#: (label, words that tell which templates of the label are meant, phrases one of which has to be there).
DECIDING = [
    ("mit", "mit license", ("mit",)),
    ("mit", "associated documentation", ("associated documentation",)),
    ("mit", "this software", ("this software",)),
    ("apache-2", "apache", ("apache",)),
    ("apache-2", "2", ("2",)),
    ("bsd", "redistribution", ("redistribution",)),
    ("bsd", "source and binary", ("binary",)),
    ("bsd", "permitted", ("permitted",)),
    ("gpl", "gnu general public", ("gnu general public", "gnu public")),
    ("mpl-2", "mozilla", ("mozilla",)),
    ("mpl-2", "2", ("2",)),
    ("cc-by", "attribution", ("attribution",)),
    ("cc-by-sa", "sharealike", ("sharealike", "share alike")),
    ("cc-by-nc", "noncommercial", ("noncommercial", "non commercial")),
    ("cc-by-nc", "by nc", ("by nc",)),
    ("cc0", "waived", ("waived",)),
    ("cc0", "copyright", ("copyright",)),
]

_NC = ("noncommercial", "non commercial")
_ND = ("noderivatives", "no derivatives", "noderivs", "no derivs")
#: Phrases of other licences. As with the phrase "cc by nc", cc-by-nc also stands for its stricter forms.
RIVALS = {
    "gpl": ("gnu lesser", "gnu library", "gnu affero"),
    "cc-by": (*_NC, *_ND, "sharealike", "share alike"),
    "cc-by-sa": (*_NC, *_ND),
}

#: A-Z become a-z, line ends stay, ASCII but letters and digits becomes a space; other bytes belong to words.
_CLASSES = bytes(c if c >= 128 or c == 10 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())

FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<line:int,label:string,containment:double>>"


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(_CLASSES)


def _joined(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def _places(joined: bytes, phrase: bytes) -> Iterator[tuple[int, int]]:
    """Numbers of the first and last word wherever the phrase stands."""
    size, at, number, seen = phrase.count(b" ") - 1, joined.find(phrase), 0, 0
    while at >= 0:
        number += joined.count(b" ", seen, at)
        seen = at
        yield number, number + size - 1
        at = joined.find(phrase, at + 1)


def line_frequencies(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> dict[bytes, int]:
    """Number of lines of all documents that have each template word; only these counts, one for a template word, reach the driver."""
    words = frozenset(w for _, t in templates for w in normalised(t).split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in (p for b in batches for p in parts(b)):
            for text in batch.column(0).to_pylist():
                for line in normalised(text).split(b"\n"):
                    total.update(words.intersection(line.split()))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = whole_text(docs).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in words} | {bytes(r.word): r.n for r in rows}


class TemplateIndex:
    """Templates as word lists in global order, filed under the words of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: Fraction = THRESHOLD) -> None:
        self.order = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.words = frozenset(self.order)
        self.templates, self.by_word, self.wanted, self.rivals, self.spans = [], {}, [], [], []
        for label, text in templates:
            own = sorted({self.order[w] for w in normalised(text).split()})
            need = ceil(threshold * len(own))
            for place, w in enumerate(own[: len(own) - need + 1]):
                self.by_word.setdefault(w, []).append((len(self.templates), place))
            self.templates.append((label, own, need))
            words = normalised(text).split()
            joined = _joined(words)
            self.wanted.append([[_joined(a.encode().split()) for a in some] for name, mark, some in DECIDING if name == label and _joined(mark.encode().split()) in joined])
            self.rivals.append([_joined(r.encode().split()) for r in RIVALS.get(label, ())])
            self.spans.append((frozenset(words), len(words)))
        self.least = min((need for _, _, need in self.templates), default=1)

    def matches(self, line: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that has enough words in the line."""
        return [(self.templates[t][0], containment) for t, containment in self.contained(line)]

    def decided(self, t: int, joined: bytes) -> bool:
        """Whether the joined words have what decides for the template."""
        return all(any(a in joined for a in some) for some in self.wanted[t])

    def contained(self, line: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that has enough words in the line."""
        common = self.words.intersection(line)
        if len(common) < self.least:
            return []
        own, seen, found = sorted(self.order[w] for w in common), set(), []
        for at, w in enumerate(own):
            for t, place in self.by_word.get(w, ()):
                label, words, need = self.templates[t]
                if t in seen:
                    continue
                seen.add(t)  # the first common word of the template's prefix decides
                if len(own) >= need and min(len(own) - at, len(words) - place) >= need:
                    both = len(set(words).intersection(own))
                    if both >= need:
                        found.append((t, both / len(words)))
        return found

    def on_line(self, line: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the line meets."""
        found = self.contained(line)
        joined = _joined(line) if found else b""
        return [(t, c) for t, c in found if self.decided(t, joined) and not any(r in joined for r in self.rivals[t])]

    def stretches(self, words: list[bytes], joined: bytes) -> Iterator[tuple[int, float, int, int]]:
        """(template, containment, first and last word) of the best of overlapping stretches that meet a template."""
        common = self.words.intersection(words)
        if len(common) < self.least:
            return
        for t, (own, length) in enumerate(self.spans):
            need = self.templates[t][2]
            if len(own & common) < need or not self.decided(t, joined):
                continue
            wanted = [sorted((e, a) for phrase in some for a, e in _places(joined, phrase)) for some in self.wanted[t]]
            rivals = sorted((e, a) for phrase in self.rivals[t] for a, e in _places(joined, phrase))
            at, latest, rival = [0] * len(wanted), [-1] * len(wanted), 0
            inside: Counter = Counter()
            places = [i for i, w in enumerate(words) if w in own]
            low, begin, best = 0, 0, None
            for last in places:
                inside[words[last]] += 1
                begin = max(begin, last - length + 1)
                while rival < len(rivals) and rivals[rival][0] <= last:  # a stretch begins behind the start of the last rival
                    begin = max(begin, rivals[rival][1] + 1)
                    rival += 1
                while low < len(places) and places[low] < begin:
                    if places[low] <= last:
                        inside[words[places[low]]] -= 1
                        if not inside[words[places[low]]]:
                            del inside[words[places[low]]]
                    low += 1
                for k, ends in enumerate(wanted):
                    while at[k] < len(ends) and ends[at[k]][0] <= last:
                        latest[k] = max(latest[k], ends[at[k]][1])
                        at[k] += 1
                if len(inside) < need or min(latest, default=begin) < begin:
                    continue
                if best and places[low] > best[2]:
                    yield (t, *best)
                    best = None
                if not best or len(inside) / len(own) > best[0]:
                    best = len(inside) / len(own), places[low], last
            if best:
                yield (t, *best)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """FOUND for every row and whole text; ``matches`` has the lines (from 0) that meet a template or begin a stretch that does."""
    frequency = line_frequencies(docs, templates)
    sought = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, frequency)
        for batch in (p for b in batches for p in parts(b)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain = normalised(text)
                words = plain.split()
                joined = _joined(words)
                starts, base, hits = [], set(), []
                for phrase, label in sought:
                    places = [first for first, _ in _places(joined, phrase)]
                    starts += places
                    base |= {label} if places else set()
                if not index.words.isdisjoint(words):
                    lines, found, met = [line.split() for line in plain.split(b"\n")], [], set()
                    for n, line in enumerate(lines):
                        for t, c in index.on_line(line):
                            found.append((n, t, c))
                            met.add((t, n))
                    ends = None
                    for t, c, first, last in index.stretches(words, joined):
                        ends = np.cumsum([len(line) for line in lines]) if ends is None else ends
                        a, b = np.searchsorted(ends, (first, last), "right").tolist()
                        if not any((t, n) in met for n in range(a, b + 1)):
                            found.append((a, t, c))
                    hits = [{"line": n, "label": index.templates[t][0], "containment": c} for n, t, c in sorted(found)]
                score = 1.0 if base else max((h["containment"] for h in hits), default=0.0)
                labels = base | {h["label"] for h in hits}
                rows.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, hits))
            match = pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), match]
            names = [c.split()[0] for c in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    return whole_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, FOUND)
