"""Licence labels of documents: phrases, and an exact containment join of text blocks with licence notices.

A template is a notice's set of words. A block is a run of words; for templates of up to m words, m a power
of two, blocks are 2m words long and start every m words, so that any run of m words lies whole in a
block. A block matches a template when it has at least the share `threshold` of the template's different words.

All such pairs are found by prefixes: words are put in one order, rarest in the corpus first. With
a words needed of a template of t, one of its first t - a + 1 words must be in the block, and one of the first
b - a + 1 of the block's b template words must be in the template (prefix filter). A block with fewer than a template
words is out (length filter); and so is a pair whose first common word leaves fewer than a - 1 words after it on either
side (positional filter). What is left is counted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.text import blocks

#: Share of a template's different words that a block must have. Templates of under 10 words must be there whole.
THRESHOLD = 0.9
#: Different words of templates that one pass holds in each worker; more templates are scanned in several passes.
VOCABULARY = 1_000_000
SLICE = 8 << 20

# Phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of public licences, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
]

#: A-Z lower-cased; ASCII that is neither letter nor digit to a blank.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all bytes beyond ASCII; A-Z lower-cased."""
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[bytes, ...]  # different ones, in the global order
    needed: int
    step: int  # half a block


@dataclass(frozen=True)
class Index:
    """Templates with their words in the global order, and the words that are in some prefix."""

    templates: tuple[Template, ...]
    rank: dict[bytes, int]
    prefixes: dict[int, dict[int, list[tuple[int, int]]]]  # step -> rank of a word -> (template's place, position in it)

    @staticmethod
    def build(templates: list[tuple[int, str, list[bytes]]], frequency: dict[bytes, int], threshold: float) -> Index:
        every = sorted({w for _, _, ws in templates for w in ws}, key=lambda w: (frequency.get(w, 0), w))
        rank = {w: k for k, w in enumerate(every)}
        made, prefixes = [], {}
        for number, label, ws in templates:
            own = tuple(sorted(set(ws), key=rank.__getitem__))
            if not own:
                continue
            needed = least(len(own), threshold)
            step = 1 << max(0, len(ws) - 1).bit_length()
            of_step = prefixes.setdefault(step, {})
            for position in range(len(own) - needed + 1):
                of_step.setdefault(rank[own[position]], []).append((len(made), position))
            made.append(Template(number, label, own, needed, step))
        return Index(tuple(made), rank, prefixes)


def least(size: int, threshold: float) -> int:
    """Words needed of a template of `size` different words, one at least."""
    return max(1, math.ceil(round(threshold * size, 9)))


class Matcher:
    """Finds the blocks of texts that match templates of an index."""

    def __init__(self, index: Index):
        self.index = index
        self.smallest = {step: min(t.needed for t in index.templates if t.step == step) for step in index.prefixes}
        self.sets = [frozenset(index.rank[w] for w in t.words) for t in index.templates]

    def matches(self, places: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template's place, block, words in common), given the places of a text's template words and their ranks."""
        index = self.index
        for step, of_step in index.prefixes.items():
            known, low_bound = np.fromiter(of_step, np.int64, len(of_step)), self.smallest[step]
            hit = places[np.isin(ranks, known)] // step
            # A word lies in the block that begins at its own step and in the one before.
            for block in np.unique(np.concatenate((hit, hit[hit > 0] - 1))).tolist():
                low, high = np.searchsorted(places, (block * step, (block + 2) * step))
                own = np.unique(ranks[low:high]).tolist()
                seen: set[int] = set()
                for at, r in enumerate(own[: max(0, len(own) - low_bound + 1)]):  # the block's prefix for its least template
                    for k, position in of_step.get(r, ()):
                        if k in seen:
                            continue
                        seen.add(k)
                        t = index.templates[k]
                        # The first common word of the two prefixes: all earlier ones of either side are not shared.
                        if len(own) - at < t.needed or len(t.words) - position < t.needed:
                            continue
                        if (common := len(self.sets[k].intersection(own))) >= t.needed:
                            yield k, block, common


_PHRASES = {tuple(p.encode().split()): label for p, label in PHRASES.items()}


def phrase_places(found: list[bytes]) -> list[tuple[int, str]]:
    """Where phrases start, and their labels."""
    out = []
    for phrase, label in _PHRASES.items():
        at = -1
        try:
            while True:
                at = found.index(phrase[0], at + 1)
                if tuple(found[at : at + len(phrase)]) == phrase:
                    out.append((at, label))
        except ValueError:
            continue
    return sorted(out)


def _frequencies(words_of_templates: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("_text").to_pylist():
                if text:
                    total.update(words_of_templates.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return run


MATCH = "array<struct<label: string, template: int, first_word: long, last_word: long, common: int, containment: double>>"


def _scan(held, names: list[str], schema: pa.Schema, first: bool):
    kept: list[Matcher] = []
    carried = {*names, "_text"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Matcher(held.value))
        matcher = kept[0]
        rank = matcher.index.rank
        for batch in batches:
            texts = [x or b"" for x in batch.column("_text").to_pylist()]
            for i, j in blocks(texts, SLICE):
                out: dict[str, list] = {"n_words": [], "phrases": [], "matches": []}
                for text in texts[i:j]:
                    found = words(text)
                    got = [rank.get(w, -1) for w in found]
                    ranks = np.array(got, np.int64)
                    places = np.flatnonzero(ranks >= 0)
                    listed = []
                    for k, block, common in matcher.matches(places, ranks[places]):
                        t = matcher.index.templates[k]
                        listed.append({"label": t.label, "template": t.number, "first_word": block * t.step, "last_word": min(len(found), (block + 2) * t.step) - 1, "common": common, "containment": common / len(t.words)})
                    out["n_words"].append(len(found))
                    out["phrases"].append([{"place": p, "label": label} for p, label in phrase_places(found)] if first else [])
                    out["matches"].append(listed)
                if not first:
                    out |= {name: batch.column(name).slice(i, j - i).to_pylist() for name in ("n_words", "phrases")}
                    out["matches"] = [[*x, *y] for x, y in zip(batch.column("matches").slice(i, j - i).to_pylist(), out["matches"])]
                yield pa.RecordBatch.from_arrays([batch.column(f.name).slice(i, j - i) if f.name in carried else pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def slices(templates: list[tuple[int, str, list[bytes]]], bound: int) -> list[list[tuple[int, str, list[bytes]]]]:
    """Templates in lists of at most `bound` words in all; a larger one has a list of its own."""
    out, size = [[]], 0
    for t in templates:
        n = len(set(t[2]))
        if out[-1] and size + n > bound:
            out.append([])
            size = 0
        out[-1].append(t)
        size += n
    return out


def scan(docs: DataFrame, keep: list[str], templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The columns `keep` of `docs`, n_words, phrases (place, label) and matches: all (block, template) pairs of at least `threshold`.

    A match gives the template's label and number, the block's first and last word, the common words and the
    containment. Null and empty texts have no words, phrases or matches. Rows are read one by one, so repeated
    rows and null ids stay. Templates without words match nothing. Columns of `docs` that clash with the new ones aren't kept.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    names = [c for c in keep if c not in {"n_words", "phrases", "matches", "_text"}]
    read = docs.select(*names, F.col(text).cast("binary").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    schema = f"{fields}{', ' if fields else ''}n_words long, phrases array<struct<place: long, label: string>>, matches {MATCH}"
    shape = to_arrow_schema(spark.createDataFrame([], schema).schema)
    numbered = [(k, label, words(t.encode())) for k, (label, t) in enumerate(templates)]
    parts = slices(numbered, VOCABULARY)
    now = read
    for k, part in enumerate(parts):
        vocabulary = frozenset(w for _, _, ws in part for w in ws)
        counted = read.select("_text").mapInArrow(_frequencies(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        frequency = {bytes(r["word"]): r["n"] for r in counted.collect()}  # at most VOCABULARY words
        held = spark.sparkContext.broadcast(Index.build(part, frequency, threshold))
        more = k + 1 < len(parts)  # the next pass needs the texts again
        shaped = pa.schema([*shape, pa.field("_text", pa.binary())]) if more else shape
        now = now.mapInArrow(_scan(held, names, shaped, k == 0), f"{schema}, _text binary" if more else schema)
    return now


def labelled(scanned: DataFrame) -> DataFrame:
    """`scanned` with n_base, first_word, last_word, base_labels, labels and score in place of phrases and matches.

    score is the highest containment found, 0 without a match.
    """
    place = F.col("phrases.place")
    out = scanned.withColumns({
        "n_base": F.size("phrases").cast("long"), "first_word": F.array_min(place), "last_word": F.array_max(place),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(F.col("phrases.label"))), ","),
        "labels": F.array_join(F.array_sort(F.array_union(F.col("phrases.label"), F.col("matches.label"))), ","),
        "score": F.coalesce(F.array_max(F.col("matches.containment")), F.lit(0.0)),
    })
    return out.drop("phrases", "matches")


def labels_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The rows of `labelled` for `documents`, in DuckDB's SQL."""
    made = []
    for k, (label, text) in enumerate(templates):
        ws = words(text.encode())
        own = sorted(set(ws))
        step = 1 << max(0, len(ws) - 1).bit_length()
        made += [f"({k}, '{label}', '{w.decode()}', {len(own)}, {least(len(own), threshold)}, {step})" for w in own]
    phrase = " UNION ALL ".join(
        f"SELECT a.d, a.pos, '{label}' AS label FROM words a " + " ".join(f"JOIN words w{n} ON w{n}.d = a.d AND w{n}.pos = a.pos + {n} AND w{n}.word = '{w}'" for n, w in enumerate(p.split()) if n) + f" WHERE a.word = '{p.split()[0]}'"
        for p, label in PHRASES.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
words AS (SELECT d, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM docs),
template(k, label, word, size, needed, step) AS (VALUES {", ".join(made)}),
near AS (SELECT w.d, t.k, t.label, t.size, t.needed, t.word, w.pos // t.step AS block FROM words w JOIN template t ON w.word = t.word),
placed AS (SELECT * FROM near UNION ALL SELECT d, k, label, size, needed, word, block - 1 FROM near WHERE block > 0),
found AS (SELECT d, k, label, block, count(DISTINCT word) / any_value(size) AS containment FROM placed GROUP BY d, k, label, block HAVING count(DISTINCT word) >= any_value(needed)),
phrases AS ({phrase}),
by_doc AS (SELECT d, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM phrases GROUP BY d),
every AS (SELECT d, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT d, label FROM phrases UNION ALL SELECT d, label FROM found) GROUP BY d),
best AS (SELECT d, max(containment) AS score FROM found GROUP BY d)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN by_doc USING (d) LEFT JOIN every USING (d) LEFT JOIN best USING (d)
"""
