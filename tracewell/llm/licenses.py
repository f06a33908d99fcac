"""License scans with a positional index of rare tokens.

Document frequencies of the words of the licence templates are counted over all documents. A template passes where
the share ``COVERAGE`` of its words stand at their places, so of any n - need + 1 of its n places one is right there. The
index has postings: for each word its (template, place) pairs, of so many places of each template, those with the highest
IDF. A file's words that have postings are looked up, the highest IDF first; each of their places in the file, less the
place in the template, is a start, and starts meet by template. A start that gathers enough of the template's indexed
places to pass is verified, after the mandatory key phrases: no place that passes is missed, however long the file and
whatever else it holds, and templates that share no indexed word with the file cost nothing. Templates that pass give
their label.

Beside these labels stand the base ones: places where a fixed phrase's words follow each other. The score is the
share at the best place of a template that passes; a file that only names a licence by a base phrase has ``NAMED``.

Null text is an empty file; files without words get null places, no labels and score 0. A text of any length is one
file, held by its task. Of equal shares at several starts the score is the same, so ties need no rule; labels are
sorted. Repeated rows and null ids give a row each; columns of other names are not read, so none can clash; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, texts
from .license_texts import WHOLE

#: lower-cases A-Z; all ASCII but digits and letters separates words
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Phrases and labels of the base.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, mandatory key phrases, text (public licence wording, shortened to its telling sentences).
TEMPLATES = [
    ("mit", ["free of charge", "without restriction"], "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", ["spdx license identifier mit"], "spdx license identifier mit"),
    ("mit", ["under the mit license"], "licensed under the mit license"),
    ("mit", ["under the mit license"], "released under the mit license"),
    ("apache", ["apache license"], "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", ["apache license"], "licensed under the apache license version 2 0"),
    ("apache", ["spdx license identifier apache"], "spdx license identifier apache 2 0"),
    ("gpl", ["gnu general public license"], "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", ["gnu general public license"], "this work is licensed under the gnu general public license version 3"),
    ("gpl", ["spdx license identifier gpl"], "spdx license identifier gpl 3 0 only"),
    ("lgpl", ["gnu lesser general public license"], "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", ["gnu affero general public license"], "modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", ["redistributions of source code"], "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", ["with or without fee"], "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", ["mozilla public license"], "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", ["creative commons attribution"], "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", ["under cc by nc"], "licensed under cc by nc 4 0"),
    ("cc-by-sa", ["under cc by sa"], "licensed under cc by sa 4 0"),
    ("cc-by", ["under cc by"], "licensed under cc by 4 0"),
    ("unlicense", ["into the public domain"], "this is free and unencumbered software released into the public domain"),
    ("epl", ["eclipse public license"], "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
]
#: the share of a template that must stand in place
COVERAGE = 0.8
#: the score of a file that names a licence and quotes none
NAMED = 0.5


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


TEMPLATES += [(label, keys, b" ".join(words(text.encode())).decode()) for label, keys, text in WHOLE]


def _phrase_places(found: list[bytes], phrase: list[bytes]) -> list[int]:
    out, at, n = [], -1, len(phrase)
    while True:
        try:
            at = found.index(phrase[0], at + 1)
        except ValueError:
            return out
        if found[at : at + n] == phrase:
            out.append(at)


def _in_place(found: list[bytes], text: list[bytes], start: int) -> int:
    """Words of ``text`` that stand at their places when it begins at ``start``, which may lie before the file."""
    return sum(map(eq, text[max(0, -start) :], found[max(0, start) : max(0, start + len(text))]))


class Index:
    """The places of each template's rarest words by IDF, as many as make a lookup of them exact."""

    def __init__(self, frequencies: dict[str, int], n_docs: int, templates=None, base=None):
        self.templates = [(label, [words(k.encode()) for k in keys], words(text.encode())) for label, keys, text in templates or TEMPLATES]
        self.base = [(phrase.encode().split(), label) for phrase, label in (base or BASE).items()]
        self.vocabulary = frozenset(w for _, keys, text in self.templates for part in [*keys, text] for w in part)
        self.idf = {w: math.log((n_docs + 1) / (frequencies.get(w.decode(), 0) + 1)) + 1e-9 for w in self.vocabulary}
        self.needs = [next(n for n in range(len(text) + 1) if n / len(text) >= COVERAGE) for _, _, text in self.templates]
        # of any len - need + 1 places at least one is right where a template passes; the rarest give the fewest starts
        self.rare = [sorted(range(len(text)), key=lambda p: (-self.idf[text[p]], p))[: len(text) - need + 1] for (_, _, text), need in zip(self.templates, self.needs)]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, places in enumerate(self.rare):
            for p in places:
                self.postings.setdefault(self.templates[t][2][p], []).append((t, p))
        self.by_idf = sorted(self.postings, key=lambda w: (-self.idf[w], w))
        self.base_words = frozenset(w for phrase, _ in self.base for w in phrase)

    def base_places(self, found: list[bytes], present: frozenset) -> tuple[list[int], set[str]]:
        places, labels = [], set()
        for phrase, label in self.base:
            if present.issuperset(phrase):
                own = _phrase_places(found, phrase)
                if own:
                    places += own
                    labels.add(label)
        return places, labels

    def scan(self, found: list[bytes], present: frozenset) -> tuple[set[str], float]:
        """Labels of the templates in the file, and the best score."""
        looked_up = [w for w in self.by_idf if w in present]
        if not looked_up:
            return set(), 0.0
        places: dict[bytes, list[int]] = {w: [] for w in looked_up}
        for at, w in enumerate(found):
            if w in places:
                places[w].append(at)
        votes: dict[int, Counter] = {}
        for w in looked_up:
            for t, p in self.postings[w]:
                votes.setdefault(t, Counter()).update(at - p for at in places[w])
        labels, score = set(), 0.0
        for t, starts in votes.items():
            label, keys, text = self.templates[t]
            # of the indexed places at most len(text) - need may be wrong, and there is one more of them
            likely = [s for s, n in starts.items() if n >= len(self.rare[t]) - (len(text) - self.needs[t])]
            if not likely or not all(present.issuperset(k) and _phrase_places(found, k) for k in keys):
                continue
            stand = max(_in_place(found, text, s) for s in likely)
            if stand >= self.needs[t]:
                labels.add(label)
                score = max(score, stand / len(text))
        return labels, score


def word_frequencies(docs: DataFrame, vocabulary) -> tuple[dict[str, int], int]:
    """Documents that hold each word of the templates (a few hundred words), and the number of documents."""
    known = frozenset(w.encode() for w in vocabulary)

    def run(batches):
        counts: Counter = Counter()
        n = 0
        for batch in batches:
            for raw in pc.cast(batch.column("text"), pa.binary()).to_pylist():
                counts.update(known.intersection(words(raw)))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in counts)]), pa.array([n, *counts.values()], pa.int64())], names=["word", "n"])

    rows = arrow_pass(texts(docs), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word: r.n for r in rows}
    return counts, counts.pop("", 0)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    frequencies, n_docs = word_frequencies(docs, {w.decode() for _, _, text in TEMPLATES for w in words(text.encode())})

    def run(batches):
        index = Index(frequencies, n_docs)
        for batch in batches:
            out = []
            for raw in pc.cast(batch.column("text"), pa.binary()).to_pylist():
                found = words(raw)
                present = (index.vocabulary | index.base_words).intersection(found)
                places, base = index.base_places(found, present)
                labels, score = index.scan(found, present)
                score = max(score, NAMED) if base else score
                out.append((len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
            if out:
                n_words, n_base, first, last, base_labels, labels, score = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_base, first, last)), pa.array(base_labels), pa.array(labels), pa.array(score, pa.float64())], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return arrow_pass(texts(docs), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
