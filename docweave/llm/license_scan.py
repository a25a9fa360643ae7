"""Licence scan with a positional rare-token index (DataFrame functions only)."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, column_name

#: Fixed phrases and their labels; every place where the words stand consecutively counts.
BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# The wording of public licence notices, and the key phrase that each cannot be without.
_NOTICES = [
    ("mit", "Released under the MIT License.", "mit license"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
        "apache license version 2 0",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license"),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        "under the terms of the gnu general public license",
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
        your option) any later version.""",
        "gnu lesser general public license",
    ),
    (
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
        "gnu affero general public license",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.""",
        "redistribution and use in source and binary forms",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "mozilla public license",
    ),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "eclipse public license"),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        "permission to use copy modify",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely.""",
        "permission is granted to anyone to use this software for any purpose",
    ),
    (
        "bsl-1.0",
        """Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or
        organization obtaining a copy of the software and accompanying documentation covered by this license.""",
        "boost software license",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0.", "cc by nd"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution sharealike"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain. CC0 1.0 Universal.", "cc0 1 0 universal"),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.""",
        "unencumbered software released into the public domain",
    ),
]
#: Licence notices: label, words of the notice, mandatory key phrase (words of the notice).
TEMPLATES = [(label, " ".join(re.findall("[a-z0-9]+", notice.lower())), key) for label, notice, key in _NOTICES]
#: So many words of highest IDF of a key phrase have their postings intersected; the key phrase is verified in any case.
LOOKUP_WORDS = 6

_DELIMITERS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_column(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered.

    One translation lowers letters and turns every delimiter into a space, at which the text is split.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), _DELIMITERS + UPPER, " " * len(_DELIMITERS) + LOWER)
    return F.array_remove(F.split(spaced, " ", -1), "")


def _literal_words(words: list[str]) -> Column:
    """An array of words as one literal text, which the optimiser splits once."""
    return F.split(F.lit(" ".join(words)), " ", -1)


def vocabulary() -> list[str]:
    """The words of key phrases and base phrases.  Its size is that of the templates, not of any corpus."""
    return sorted({w for _, _, key in TEMPLATES for w in key.split()} | {w for p, _ in BASE_PHRASES for w in p.split()})


def _key_offset(parts: list[str], key_parts: list[str]) -> int:
    return next(i for i in range(len(parts)) if parts[i : i + len(key_parts)] == key_parts)


def template_postings(df: list[tuple[str, int]], total: int) -> list[list[tuple[str, int]]]:
    """Index: the rarest words of each template's key phrase, rarest first, and their places in the notice."""
    known = dict(df)
    idf = lambda w: math.log((1 + total) / (1 + known.get(w, 0))) + 1
    index = []
    for _, notice, key in TEMPLATES:
        offset, key_parts = _key_offset(notice.split(), key.split()), key.split()
        rarest = sorted(set(key_parts), key=lambda w: (-idf(w), w))[:LOOKUP_WORDS]
        index.append([(w, offset + key_parts.index(w)) for w in rarest if key_parts.count(w) == 1])
    return index


def base_starts(words: Column, phrase: str) -> Column:
    """Array of the places (from 0) where the phrase stands."""
    parts = phrase.split()
    tail = lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == p for k, p in enumerate(parts) if k))
    marked = F.transform(words, lambda w, i: F.when((w == parts[0]) & tail(i), i))
    return F.filter(marked, lambda i: i.isNotNull())


def document_frequencies(docs: DataFrame, words: str) -> tuple[list[tuple[str, int]], int]:
    """How many documents hold each index word; a row per word of the vocabulary reaches the driver."""
    vocabulary_words = _literal_words(vocabulary())
    held = docs.select(F.explode(F.array_append(F.array_intersect(words, vocabulary_words), F.lit(""))).alias("w"))
    counts = [(r.w, r.n) for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()]
    return sorted((w, n) for w, n in counts if w), sum(n for w, n in counts if not w)


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _template_result(t: int, rare: list[tuple[str, int]], words: str, occurrences: str, held: str) -> Column:
    """(label, best score of the verified starts of template ``t``, or null), from columns of these names.

    The places of each rare word, less its place in the notice, are the starts that it proposes;
    their intersection over the rare words is verified, so the work is linear in the occurrences.
    """
    label, notice, key = TEMPLATES[t]
    offset = _key_offset(notice.split(), key.split())
    proposed = [f"transform(filter(`{occurrences}`, x -> x.w = '{w}'), x -> x.i - {p})" for w, p in rare]
    starts = reduce(lambda a, b: f"array_intersect({a}, {b})", proposed)
    key_there = " AND ".join(f"get(`{words}`, s + {offset + k}) = '{w}'" for k, w in enumerate(key.split()))
    share = f"size(filter(transform(split('{notice}', ' ', -1), (w, k) -> get(`{words}`, s + k) <=> w), y -> y)) / {len(notice.split())}D"
    best = f"array_max(transform(filter({starts}, s -> coalesce({key_there}, false)), s -> {share}))"
    return F.expr(f"named_struct('label', '{label}', 'score', CASE WHEN array_contains(`{held}`, {t}) THEN {best} END)")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score; no join.

    Base: all places of BASE_PHRASES.  Method: every template that has all words of its key phrase
    in the file is looked up by the ``LOOKUP_WORDS`` of them that have the highest IDF (counted over
    all documents): the starts that their places propose (place minus position in the template) are
    intersected, and a start stays if the key phrase stands at its place from there.  All lookup
    words agree where the phrase stands, so every key phrase of the text is found, whatever else the
    file holds.  Its share of the template's words, compared at their relative positions, is its
    score; a base label scores 1.

    Null and empty texts have no words, labels '' and score 0; whole texts are read, whatever their
    length, in time linear in it; of several places of a template the best scores, of ties any, as
    they are equal; repeated rows get equal results; columns of ``docs`` that have one of the added
    names are replaced; an empty table gives no rows.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    docs = docs.drop(*added)
    names = {c: column_name(docs, f"_{c}") for c in ("words", "known", "starts", "found", "held", "occurrences")}
    words, known, held, occurrences = (F.col(names[c]) for c in ("words", "known", "held", "occurrences"))
    split = docs.withColumn(names["words"], words_column(F.col(text)))
    frequencies, total = document_frequencies(split, names["words"])
    postings = template_postings(frequencies, total)
    split = split.withColumn(names["known"], F.array_intersect(words, _literal_words(vocabulary())))

    # Base places; words of texts that lack one of a phrase's words are not walked through.
    none = F.array().cast("array<int>")
    has = lambda parts: _all(F.array_contains(known, w) for w in parts)
    starts = [F.when(has(p.split()), base_starts(words, p)).otherwise(none) for p, _ in BASE_PHRASES]
    placed = split.withColumn(names["starts"], F.array(*starts))
    at = F.col(names["starts"])

    # Templates whose whole key phrase the file may hold, rarest words asked first; then one walk through
    # the file collects all places of the rare words of those templates.
    rarity = dict(frequencies)
    by_rarity = lambda key: sorted(set(key.split()), key=lambda w: (rarity.get(w, 0), w))
    placed = placed.withColumn(names["held"], F.array_compact(F.array(*(F.when(has(by_rarity(key)), F.lit(t)) for t, (_, _, key) in enumerate(TEMPLATES)))))
    by_template = F.array(*(_literal_words([w for w, _ in p]) for p in postings))
    rare = F.array_distinct(F.flatten(F.transform(held, lambda t: F.get(by_template, t))))
    walked = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(rare, x["w"]))
    placed = placed.withColumn(names["occurrences"], F.when(F.size(held) > 0, walked))
    results = F.array(*(_template_result(t, postings[t], names["words"], names["occurrences"], names["held"]) for t in range(len(TEMPLATES))))
    found = F.when(F.size(held) > 0, F.filter(results, lambda x: x["score"].isNotNull())).otherwise(F.array().cast("array<struct<label:string,score:double>>"))
    placed = placed.withColumn(names["found"], found)
    found = F.col(names["found"])
    every = F.flatten(at)
    base = F.array_compact(F.array(*(F.when(F.size(at[k]) > 0, label) for k, (_, label) in enumerate(BASE_PHRASES))))
    labels = F.concat(base, F.transform(found, lambda x: x["label"]))
    best = F.coalesce(F.array_max(F.transform(found, lambda x: x["score"])), F.lit(0.0))
    return placed.select(
        *(F.col(c) for c in docs.columns),
        F.size(words).cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(best).alias("score"),
    )
