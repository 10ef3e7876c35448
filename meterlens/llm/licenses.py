"""License notices in texts: winnowed fingerprints of templates pick candidates, banded alignment confirms them.

Texts and templates are sequences of words (letters and digits, ASCII letters folded). The hashes of `GRAM` words in a row
are winnowed: of every `WINNOW` of them in a row the smallest is a fingerprint, so any run of GRAM + WINNOW - 1 equal words
shares one. The inverted index maps the fingerprints of the templates to (template, position); it holds the given templates
only, never the documents. Hits of one template on nearby diagonals are one candidate; there a local alignment in a band
around the diagonals reports how many template words are matched, and the span of the text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlens.llm.common import Words, byte_classes, grams, prepare, text_buffers

GRAM, WINNOW = 3, 2
#: Diagonals to each side of the hits that the alignment may use: inserted or left-out words.
BAND = 8
#: Least share of a template's words for a report.
COVERAGE = 0.6
#: Bytes of all templates together; the index goes to every task.
TEMPLATE_BYTES = 8 << 20

# Public notices of common licenses. `long` ones are the notices that authors are told to put into files.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "mit-short": "Released under the MIT License",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."
    ),
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "cc-by-4.0-short": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}

#: Bytes that are part of words; bytes above 127 belong to letters of other scripts.
WORD_BYTES = [b for b in range(256) if b > 127 or chr(b).isalnum()]
KIND = byte_classes([b for b in range(256) if b not in WORD_BYTES])

SCHEMA = (
    "template string, coverage double, matched long, template_words long, word_start long, word_end long, "
    "char_start long, char_end long"
)


def winnow(hashes: np.ndarray, width: int = WINNOW) -> np.ndarray:
    """Positions of the smallest of every `width` hashes in a row, the rightmost of equals; all of a shorter sequence."""
    if len(hashes) <= width:
        return np.arange(len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    return np.unique(np.arange(len(windows)) + width - 1 - windows[:, ::-1].argmin(axis=1))


@dataclass
class Index:
    """Sorted fingerprints of the templates with the template and position of each, and the templates' word hashes."""

    names: list[str]
    words: list[np.ndarray]
    prints: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def hashed(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    data, ends = text_buffers(pa.array(texts, pa.large_string()))
    return Words(data, ends, KIND), data, ends


def build_index(templates: dict[str, str]) -> Index:
    if sum(len(t.encode()) for t in templates.values()) > TEMPLATE_BYTES:
        raise ValueError(f"templates of more than {TEMPLATE_BYTES} bytes do not go to every task")
    names = sorted(templates)
    words, _, _ = hashed([templates[n] for n in names])
    whole = grams(words, GRAM)
    parts, owner, place, kept = [], [], [], []
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if b - a < GRAM:
            raise ValueError(f"template {names[i]} has fewer than {GRAM} words")
        own = whole[a : b - GRAM + 1]
        at = winnow(own)
        kept.append(words.hash[a:b])
        parts.append(own[at])
        owner.append(np.full(len(at), i))
        place.append(at)
    if not names:
        none = np.zeros(0, np.int64)
        return Index([], [], np.zeros(0, np.uint64), none, none)
    prints = np.concatenate(parts)
    order = np.argsort(prints, kind="stable")
    return Index(names, kept, prints[order], np.concatenate(owner)[order], np.concatenate(place)[order])


def align(text: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with text position - template position in [low, high]: matched words, start and end in text.

    A match scores 2, a mismatch and a gap -1. Of equal scores the first in the text wins.
    """
    width = high - low + 1
    score = np.zeros(width + 1, np.int64)
    begin = np.zeros(width + 1, np.int64)
    hits = np.zeros(width + 1, np.int64)
    best = (0, 0, 0, 0)
    for j, word in enumerate(template):
        old_score, old_begin, old_hits = score, begin, hits
        score, begin, hits = np.zeros_like(score), np.zeros_like(begin), np.zeros_like(hits)
        for d in range(width):
            i = j + low + d
            if i < 0 or i >= len(text):
                continue
            same = text[i] == word
            value, start, count = 0, i, 0
            diagonal = int(old_score[d])
            if same:
                value, start, count = diagonal + 2, int(old_begin[d]) if diagonal else i, int(old_hits[d]) + 1 if diagonal else 1
            elif diagonal > 1:
                value, start, count = diagonal - 1, int(old_begin[d]), int(old_hits[d])
            if d + 1 < width and old_score[d + 1] - 1 > value:
                value, start, count = int(old_score[d + 1]) - 1, int(old_begin[d + 1]), int(old_hits[d + 1])
            if d and score[d - 1] - 1 > value:
                value, start, count = int(score[d - 1]) - 1, int(begin[d - 1]), int(hits[d - 1])
            score[d], begin[d], hits[d] = value, start, count
            if same and (value, count) > best[:2]:
                best = (value, count, start, i + 1)
    return best[1:]


def find_licenses(index: Index, words: np.ndarray, prints: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, word after the last) of a text from its word hashes and its word grams."""
    at = winnow(prints)
    low = np.searchsorted(index.prints, prints[at], "left")
    many = np.searchsorted(index.prints, prints[at], "right") - low
    found = np.flatnonzero(many)
    hits = sorted(
        (int(index.owner[k]), int(at[f]) - int(index.place[k]))
        for f in found
        for k in range(low[f], low[f] + many[f])
    )
    out, i = [], 0
    while i < len(hits):
        j = i + 1
        while j < len(hits) and hits[j][0] == hits[i][0] and hits[j][1] - hits[j - 1][1] <= BAND:
            j += 1
        owner, first, last = hits[i][0], hits[i][1], hits[j - 1][1]
        template = index.words[owner]
        # Long chains of near hits (a notice many times in a row) are aligned piece by piece.
        while first <= last:
            upto = min(last, first + len(template) // 2 + BAND)
            base = max(0, first - BAND)
            part = words[base : upto + BAND + len(template)].copy()
            while True:
                matched, a, b = align(part, template, first - BAND - base, upto + BAND - base)
                if matched < COVERAGE * len(template):
                    break
                out.append((owner, matched, base + a, base + b))
                part[a:b] = 0  # what is taken is no word any more; the notice may stand here again
            beyond = [h[1] for h in hits[i:j] if h[1] > upto]
            first = beyond[0] if beyond else last + 1
        i = j
    return best_of(out, index)


def best_of(found: list[tuple[int, int, int, int]], index: Index) -> list[tuple[int, int, int, int]]:
    """Of overlapping reports the one with the most matched words, then the highest coverage, then the first name."""
    rank = sorted(set(found), key=lambda f: (-f[1], -f[1] / len(index.words[f[0]]), f[2], index.names[f[0]]))
    taken: list[tuple[int, int, int, int]] = []
    for f in rank:
        spot = bisect_left(taken, f[2], key=lambda t: t[2])
        if (spot == len(taken) or f[3] <= taken[spot][2]) and (not spot or taken[spot - 1][3] <= f[2]):
            taken.insert(spot, f)
    return taken


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per notice found: doc_id, template, coverage (share of template words matched), matched words, word and
    code point span (end exclusive) in the whole text.

    Null, empty and unlicensed texts give no row; repeated rows give their rows again; an empty table gives an empty
    result. Of notices that overlap, the one with the most matched words is reported. doc_id keeps its type and may be
    null; other columns of `docs` are not looked at.
    """
    index = build_index(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffers(batch.column(1))
            words = Words(data, ends, KIND)
            whole = grams(words, GRAM)
            known = np.zeros(len(whole), bool)
            if len(index.prints):
                spot = np.minimum(np.searchsorted(index.prints, whole), len(index.prints) - 1)
                known = index.prints[spot] == whole
            rows: list[tuple] = []
            owners: list[int] = []
            for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                if b - a < GRAM or not known[a : b - GRAM + 1].any():
                    continue
                text = data[ends[i] : ends[i + 1]]
                begins = np.cumsum((text & 0xC0) != 0x80)
                for owner, matched, x, y in find_licenses(index, words.hash[a:b], whole[a : b - GRAM + 1]):
                    size = len(index.words[owner])
                    first, last = words.start[a + x] - ends[i], words.end[a + y - 1] - 1 - ends[i]
                    owners.append(i)
                    span = (int(begins[first]) - 1, int(begins[last]))
                    rows.append((index.names[owner], matched / size, matched, size, x, y, *span))
            types = [pa.string(), pa.float64()] + [pa.int64()] * 6
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            ids = batch.column(0).take(pa.array(owners, pa.int64()))
            arrays = [ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
