"""Licence scans: a positional index of rare tokens finds templates in files, key phrases verify them."""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, struct

# The phrases that results must report, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short forms that name a licence, word for word.
PHRASES = {
    "mit license": "mit",
    "apache license version 2 0": "apache-2.0",
    "apache license 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "cc0 1 0 universal": "cc0-1.0",
}
#: Identifiers that a machine-readable line of a source file may name.
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense", "Zlib") + tuple(f"{k}-{how}" for k in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for how in ("only", "or-later"))

# Published notices, with the phrases that each must hold.
NOTICES = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
        ("permission is hereby granted free of charge", "sublicense and or sell"),
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        ("with or without fee is hereby granted",),
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
        ("redistribution and use in source and binary forms", "must reproduce the above copyright notice"),
    ),
    (
        "bsd-3-clause",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.""",
        ("may be used to endorse or promote products",),
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
        ("apache license version 2 0", "in compliance with the license"),
    ),
    (
        "gpl-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.""",
        ("gnu general public license", "version 3 of the license"),
    ),
    (
        "gpl-2.0-or-later",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version.""",
        ("gnu general public license", "version 2 of the license"),
    ),
    (
        "lgpl-2.1-or-later",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
        later version.""",
        ("gnu lesser general public license", "version 2 1 of the license"),
    ),
    (
        "agpl-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.""",
        ("gnu affero general public license", "version 3 of the license"),
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ("mozilla public license v 2 0",),
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
        ("free and unencumbered software", "public domain"),
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely.""",
        ("held liable for any damages arising", "alter it and redistribute it freely"),
    ),
    (
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software.""",
        ("covered by this license", "prepare derivative works of the software"),
    ),
)

#: Words that a notice may have shifted; the share of its words that must stand in place; index words that must agree.
DRIFT, SHARE, AGREE = 3, 0.8, 3
RESULT = struct("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


@dataclass(frozen=True)
class Template:
    """Words that stand for a licence: a phrase, which must stand as it is, or a notice, which may have changed a little."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[str, ...], ...] = ()
    base: bool = False

    @property
    def least(self) -> int:
        """Words that must stand in place."""
        return math.ceil(SHARE * len(self.words)) if self.keys else len(self.words)


def words_of(text: str) -> tuple[str, ...]:
    return tuple(w.decode() for w in ascii_words(text.encode()))


@functools.cache
def templates() -> tuple[Template, ...]:
    out = [Template(label, words_of(p), base=True) for p, label in BASE.items()]
    out += [Template(label, words_of(p)) for p, label in PHRASES.items()]
    out += [Template(s.lower(), words_of(f"SPDX-License-Identifier: {s}")) for s in SPDX]
    return (*out, *(Template(label, words_of(text), tuple(map(words_of, keys))) for label, text, keys in NOTICES))


@dataclass
class Index:
    """Postings (template, place in it) of each template's rarest words, by word; and what words are worth.

    A notice that counts has ``least`` of its ``m`` words in place, so at least ``AGREE`` of its
    ``m - least + AGREE`` rarest places agree on where it begins: those are indexed and no match
    is lost. Of a phrase one place is enough.
    """

    templates: tuple[Template, ...]
    ids: dict[bytes, int]
    idf: np.ndarray
    postings: dict[int, list[tuple[int, int]]]
    rare: frozenset[bytes]

    @classmethod
    def make(cls, files: int, count: dict[str, int], known: tuple[Template, ...] | None = None) -> Index:
        """An index of templates by how many of ``files`` files hold each word."""
        known = templates() if known is None else known
        vocabulary = sorted({w for t in known for w in (*t.words, *(w for k in t.keys for w in k))})
        ids = {w.encode(): i for i, w in enumerate(vocabulary)}
        idf = np.array([1 + math.log((files + 1) / (count.get(w, 0) + 1)) for w in vocabulary])
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(known):
            order = sorted(range(len(t.words)), key=lambda i: (count.get(t.words[i], 0), t.words[i], i))
            for i in order[: len(t.words) - t.least + AGREE if t.keys else 1]:
                postings[ids[t.words[i].encode()]].append((k, i))
        return cls(known, ids, idf, dict(postings), frozenset(w for w, i in ids.items() if i in postings))


class File:
    """Where the words of the vocabulary stand in a file."""

    def __init__(self, words: list[bytes], index: Index):
        get = index.ids.get
        found = [(i, p) for p, w in enumerate(words) if (i := get(w)) is not None]
        self.size = len(words)
        ids, places = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        order = np.argsort(ids, kind="stable")
        self.places, self.bounds = places[order], np.searchsorted(ids[order], np.arange(len(index.ids) + 1))

    def at(self, word: int) -> np.ndarray:
        return self.places[self.bounds[word] : self.bounds[word + 1]]

    def standing(self, starts: np.ndarray, words: list[int]) -> np.ndarray:
        """Those of ``starts`` at which the words stand one after another."""
        for i, w in enumerate(words):
            starts = starts[np.isin(starts + i, self.at(w))]
        return starts


def scan(words: list[bytes], index: Index) -> list[tuple[int, np.ndarray, float]]:
    """(template, starts, score) of each template found in a file, given by its words.

    The file's rare licence words fetch postings; a word's place less its place in the template is
    where the template would begin. Phrases are verified word by word at each such place. For a
    notice the places on which ``AGREE`` postings agree, give or take ``DRIFT`` words, are scored:
    the share of its words, weighed by rarity, that stand where they should, give or take as much;
    and each of its key phrases must stand there.
    """
    if index.rare.isdisjoint(words):
        return []
    file = File(words, index)
    votes: dict[int, list[np.ndarray]] = defaultdict(list)
    for w, posts in index.postings.items():
        at = file.at(w)
        if len(at):
            for k, i in posts:
                votes[k].append(at - i)
    out = []
    for k in sorted(votes):
        t, begins = index.templates[k], np.sort(np.concatenate(votes[k]))
        ids = [index.ids[w.encode()] for w in t.words]
        if not t.keys:
            starts = file.standing(np.unique(begins), ids)
            if len(starts):
                out.append((k, starts, 1.0))
            continue
        starts = np.unique(begins)
        starts = starts[np.searchsorted(begins, starts + DRIFT, "right") - np.searchsorted(begins, starts - DRIFT) >= AGREE]
        n, worth = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        for i, w in enumerate(ids):
            at = file.at(w)
            here = np.searchsorted(at, starts + (i + DRIFT), "right") > np.searchsorted(at, starts + (i - DRIFT))
            n += here
            worth += index.idf[w] * here
        good = n >= t.least
        for key in t.keys:
            ids_of = [index.ids[w.encode()] for w in key]
            at = file.standing(file.at(ids_of[0]), ids_of)
            good &= np.searchsorted(at, starts + len(ids) + DRIFT, "right") > np.searchsorted(at, starts - DRIFT)
        if good.any():
            out.append((k, starts[good], round(float(worth[good].max() / index.idf[ids].sum()), 6)))
    return out


def document_counts(df: DataFrame, text: str | Column) -> tuple[int, dict[str, int]]:
    """Rows, and how many of them hold each word of the templates; the driver gets a number a word.

    All rows count. A task sends one row for each word it has met, whatever its number of rows.
    """
    known = frozenset(w.encode() for t in templates() for w in (*t.words, *(w for k in t.keys for w in k)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, total = 0, Counter()
        for b in batches:
            rows += len(b)
            for x in b["text"]:
                total.update(known.intersection(ascii_words(x)) if x else ())
        yield pd.DataFrame({"word": [None, *(w.decode() for w in total)], "n": [rows, *total.values()]})

    texts = df.select((F.col(text) if isinstance(text, str) else text).cast("binary").alias("text"))
    n = {r.word: r.n for r in texts.mapInPandas(count, struct("word string, n long")).groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return n.pop(None, 0), n


def summary(words: list[bytes], index: Index) -> tuple:
    """What a file's row says: words, base places and their ends, base labels, all labels, the best score."""
    found = scan(words, index)
    base = [(index.templates[k].label, starts) for k, starts, _ in found if index.templates[k].base]
    n = sum(len(starts) for _, starts in base)
    ends = (int(min(s.min() for _, s in base)), int(max(s.max() for _, s in base))) if base else (None, None)
    labels = (sorted({label for label, _ in base}), sorted({index.templates[k].label for k, *_ in found}))
    return len(words), n, *ends, *map(",".join, labels), max((s for *_, s in found), default=0.0)


def scan_licenses(df: DataFrame, text: str | Column = "text", out: str = "license") -> DataFrame:
    """Add a struct column ``out`` with the licences that a text column names or quotes.

    One pass counts, over all rows, in how many each licence word occurs, which ranks the words of
    the index; a second scans row by row, without a shuffle, so that nothing can be hot. Base
    phrases are reported at each of their places; ``first_word`` and ``last_word`` are null where
    there is none. ``score`` is the best share of a template's words, weighed by rarity, 0 without
    a label. Null and empty texts have no words; whole texts are read, in time about linear in
    their length. Equal rows get equal results. A column named ``out`` is replaced, others stay.
    """
    index = Index.make(*document_counts(df, text))

    @F.pandas_udf(RESULT)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = [summary(ascii_words(x or b""), index) for x in texts]
        table = pd.DataFrame(rows, columns=RESULT.names)
        return table.astype({"first_word": "Int64", "last_word": "Int64"})

    return df.withColumn(out, scanned((F.col(text) if isinstance(text, str) else text).cast("binary")))
