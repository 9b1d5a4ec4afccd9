"""Licence scan: a positional index of template words, intersected by place and verified per file.

Templates are licence notices, identifier lines and the opening clauses of licence bodies, each
with the key phrases it must contain. All template words are indexed with their postings
(template, position). A file's licence words are walked from the highest inverse document
frequency down; every occurrence of a word gives, through its posting, the place where
the template would have to begin, and the places that the words of the key phrases give are
intersected. What is left must hold the key phrases word by word; the score is the IDF mass of
the template words found in place. Frequencies are counted over all documents, for the words
of the templates only, so they are few whatever the corpus.

A template is dropped as soon as no place is left, and at once if a word of its key phrases is
missing in the file. No file is too full of notices and no word too frequent in it: all
occurrences take part, and each intersection costs no more than the places left from rarer words.

Defined results: a null text is empty (no words, no labels, score 0); repeated rows and ids
are scanned row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# ASCII letters are lower-cased; every byte of a non-ASCII character belongs to a word.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


# Phrases every scan counts, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Short notices with the phrases that must stand in them.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted free of charge",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)

# Labels and the identifiers that stand for them in SPDX lines.
IDENTIFIERS = (
    ("agpl-3.0", "agpl 3 0"), ("apache-2.0", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("bsl-1.0", "bsl 1 0"),
    ("cc-by-nc", "cc by nc 4 0"), ("cc-by-nd", "cc by nd 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc0", "cc0 1 0"), ("epl-2.0", "epl 2 0"),
    ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("isc", "isc"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("mit", "mit"),
    ("mpl-2.0", "mpl 2 0"), ("unlicense", "unlicense"), ("zlib", "zlib"),
)

# Opening clauses of public licences, with the phrases that must stand in them.
BODIES = (
    Template(
        "agpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu affero general public license as published by the free software foundation",)),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at",
        ("apache license version 2 0", "except in compliance with the license")),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice")),
    Template(
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license",
        ("free of charge to any person or organization obtaining a copy of the software",)),
    Template(
        "epl-2.0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0",
        ("eclipse public license v 2 0",)),
    Template(
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation", "either version 2 of the license")),
    Template(
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation", "either version 3 of the license")),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
        "as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ("gnu lesser general public license as published by the free software foundation",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to "
        "do so subject to the following conditions",
        ("permission is hereby granted free of charge", "to use copy modify merge publish distribute sublicense and or sell copies")),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
        "with this file you can obtain one at",
        ("mozilla public license", "a copy of the mpl was not distributed with this file")),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell "
        "or distribute this software",
        ("free and unencumbered software released into the public domain",)),
    Template(
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
        "redistribute it freely subject to the following restrictions",
        ("permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely")),
)

TEMPLATES = (
    *(Template(label, phrase, (phrase,)) for phrase, label in BASE),
    *NOTICES,
    *(Template(label, line, (line,)) for label, line in ((i, f"spdx license identifier {n}") for i, n in IDENTIFIERS)),
    *BODIES,
)


def words_of(text: bytes | None) -> list[bytes]:
    return _WORDS((text or b"").lower())


def document_frequencies(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and how many hold each template word."""
    vocabulary = frozenset(w for t in templates for w in words_of(t.text.encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                seen.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.record_batch([pa.array([b"", *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "word binary, n long")
    found = {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), found


class Index:
    """Templates as word lists, with the IDF and the postings of all their words."""

    def __init__(self, templates: Sequence[Template], n_docs: int, frequency: dict[bytes, int]):
        self.labels = [t.label for t in templates]
        self.words = [words_of(t.text.encode()) for t in templates]
        self.idf = {w: log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1e-6 for ws in self.words for w in ws}
        self.mass = [sum(self.idf[w] for w in ws) for ws in self.words]
        self.phrases: list[list[tuple[int, list[bytes]]]] = []
        for own, t in zip(self.words, templates):
            parts = [words_of(phrase.encode()) for phrase in t.phrases]
            self.phrases.append([(next(p for p in range(len(own)) if own[p:p + len(q)] == q), q) for q in parts])
        # The places that a key phrase covers, and the words a file must hold for them.
        self.mandatory = [frozenset(at + k for at, q in placed for k in range(len(q))) for placed in self.phrases]
        self.needed = [frozenset(w for _, q in placed for w in q) for placed in self.phrases]
        postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, own in enumerate(self.words):
            for p, w in enumerate(own):
                postings[w].append((t, p))
        self.postings = dict(sorted(postings.items(), key=lambda x: (-self.idf[x[0]], x[0])))
        self.vocabulary = frozenset().union(*self.needed)
        # Without the rarest word of some template's phrases a file can match nothing.
        self.keys = frozenset(max(needed, key=lambda w: (self.idf[w], w)) for needed in self.needed)

    def starts(self, words: list[bytes]) -> dict[int, set[int]]:
        """Per template the places where all words of its key phrases point to as its start."""
        if self.keys.isdisjoint(words):
            return {}
        present = self.vocabulary.intersection(words)
        alive = {t for t, needed in enumerate(self.needed) if needed <= present}
        wanted = frozenset().union(*(self.needed[t] for t in alive))
        places: dict[bytes, set[int]] = {w: set() for w in self.postings if w in wanted}  # IDF falling
        for i, w in enumerate(words if alive else ()):
            if w in wanted:
                places[w].add(i)
        left: dict[int, set[int]] = {}
        for w, held in places.items():
            for t, p in self.postings[w]:
                if t in alive and p in self.mandatory[t]:
                    left[t] = {s for s in left[t] if s + p in held} if t in left else {i - p for i in held}
                    if not left[t]:
                        alive.remove(t)
        return {t: left[t] for t in alive}

    def match(self, words: list[bytes]) -> dict[str, float]:
        """Labels of the templates found, each with its best score."""
        found: dict[str, float] = {}
        for t, starts in self.starts(words).items():
            for start in starts:
                if all(words[start + at:start + at + len(parts)] == parts for at, parts in self.phrases[t]):
                    held = sum(self.idf[w] for p, w in enumerate(self.words[t]) if 0 <= start + p < len(words) and words[start + p] == w)
                    found[self.labels[t]] = max(found.get(self.labels[t], 0.0), min(1.0, held / self.mass[t]))
        return found


def base_places(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Starts of all base phrases, and the labels of those found."""
    starts, labels, present = [], set(), set(words)
    for phrase, label in BASE:
        parts = [p.encode() for p in phrase.split()]
        if present.issuperset(parts):
            at = [i for i, w in enumerate(words) if w == parts[0] and words[i:i + len(parts)] == parts]
            if at:
                starts += at
                labels.add(label)
    return starts, labels


def scanned(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: words, places of base phrases, labels and score."""
    index = Index(templates, *document_frequencies(docs, templates, text_col))
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double")
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                starts, base = base_places(words)
                found = index.match(words)
                rows.append((
                    len(words), len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | found.keys())), max(found.values(), default=0.0),
                ))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(scan, schema)
