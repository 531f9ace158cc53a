"""Licence scan by a positional index of rare words.

Each licence template keeps its rarest words, by document frequency over all files, with their positions.  Words of a
file that the index knows give votes (template, position in file - position in template); where enough of a template
meets at one relative position, its mandatory key phrases are looked for there.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.llm.common import text_of

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

#: Phrases and labels of the base.  Fixed values.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Licence notices as their publishers word them: label, notice, mandatory phrases.  Fixed values.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted", "without restriction")),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Licensed under the MIT License", ("mit license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee", "is hereby granted")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("in compliance with the license", "licenses license 2 0")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("free software", "gnu general public license")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
)
#: Rare words kept of a template; words by which a file's copy may shift against it; least share of their weight that must meet.
RARE, SLACK, LEAST = 8, 3, 0.7


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


def vocabulary() -> set[str]:
    return {w for _, t, _ in TEMPLATES for w in words_of(t)}


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of files, and of those that hold each template word, over all files.  At most a row a template word comes back."""
    known = vocabulary()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, held = 0, Counter()
        for pdf in batches:
            n += len(pdf)
            for t in pdf["_t"]:
                held.update(known.intersection(words_of(t)))
        yield pd.DataFrame([("", n), *held.items()], columns=["word", "n"])

    rows = docs.select(text_of(text).alias("_t")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r.word: r.n for r in rows}
    return df.pop("", 0), df


class Index:
    """word -> places (template, position, weight); weights by rarity over the files."""

    def __init__(self, files: int, frequency: dict[str, int]):
        self.places: dict[str, list[tuple[int, int, float]]] = defaultdict(list)
        self.total, self.keys, self.length = [], [], []
        idf = lambda w: math.log((1 + files) / (1 + frequency.get(w, 0))) + 0.1
        for t, (_, notice, phrases) in enumerate(TEMPLATES):
            ws = words_of(notice)
            rare = sorted(set(ws), key=lambda w: (-idf(w), w))[:RARE]
            at = [(p, w) for p, w in enumerate(ws) if w in rare]
            for p, w in at:
                self.places[w].append((t, p, idf(w)))
            self.length.append(len(ws))
            self.total.append(sum(idf(w) for _, w in at))
            self.keys.append([(phrase.split(), _find(ws, phrase.split())) for phrase in phrases])

    def matches(self, words: list[str]) -> list[tuple[str, int, float]]:
        """(label, first word, share of the template's rare weight) of each separate place of each template found."""
        votes: dict[int, dict[int, dict[int, float]]] = defaultdict(lambda: defaultdict(dict))
        for i, w in enumerate(words):
            if w in self.places:
                for t, p, weight in self.places[w]:
                    votes[t][i - p][p] = weight
        out = []
        for t, places in sorted(votes.items()):
            least = self.total[t] * LEAST - 1e-9
            if sum(sum(met.values()) for met in places.values()) < least:
                continue
            weight = {at: sum(met.values()) for at, met in places.items()}
            near = []
            for at in {*places, *(lo + SLACK for lo in places)}:   # words put in or left out shift the rest to either side
                window = range(at - SLACK, at + SLACK + 1)
                if sum(weight.get(k, 0.0) for k in window) < least:
                    continue
                met: dict[int, float] = {}
                for k in window:
                    met |= places.get(k, {})
                if sum(met.values()) >= least:
                    near.append((-sum(met.values()) / self.total[t], at not in places, at))
            taken: list[int] = []
            apart = max(self.length[t] - 2 * SLACK, min(self.length[t], 2 * SLACK + 1))
            for share, _, at in sorted(near):   # best first; what overlaps a place taken is the same copy
                i = bisect.bisect_left(taken, at)
                if all(abs(at - other) >= apart for other in taken[max(0, i - 1):i + 1]) and self._phrases(words, t, at):
                    taken.insert(i, at)
                    out.append((t, max(0, at), min(1.0, -share)))
        return [(TEMPLATES[t][0], at, share) for t, at, share in sorted(out)]

    def _phrases(self, words: list[str], t: int, at: int) -> bool:
        return all(any(words[max(0, at + p + k):max(0, at + p + k) + len(phrase)] == phrase for k in range(-2 * SLACK, 2 * SLACK + 1))
                   for phrase, p in self.keys[t])


def _find(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)


_PHRASES = [(p.split(), label) for p, label in BASE]


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a base phrase stands, overlapping or not."""
    out = []
    for phrase, label in _PHRASES:
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at:at + len(phrase)] == phrase:
                out.append((at, label))
    return out


def licences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found) of every row.

    ``found`` has label:first word:share of each separate place of a template that the index finds; ``score`` is the best share, and at
    least a half where a base phrase stands.  Null and empty texts have no words, no labels and score 0.  Rows are
    looked at alone; columns besides id and text are not read.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(*document_frequency(docs, text)))   # as large as the templates

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = index.value
        for texts in batches:
            rows = []
            for t in texts:
                ws = words_of(t)
                base, found = base_places(ws), of.matches(ws)
                starts = [s for s, _ in base]
                own = {label for _, label in base}
                rows.append((len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
                             ",".join(sorted(own | {m[0] for m in found})), max([0.5 * bool(base), *(m[2] for m in found)]),
                             ",".join(f"{a}:{b}:{c:.3f}" for a, b, c in found)))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64", "score": "float64"})

    return docs.select(F.col(doc_id).alias("doc_id"), scan(text_of(text)).alias("f")).select("doc_id", "f.*")
