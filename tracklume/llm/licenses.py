"""License notices in texts by patience alignment.

A template is aligned with a stretch of a text: words that occur once in both are anchors, the longest increasing
subsequence of their places (found as in patience sorting) keeps those in a common order, and the gaps between anchors are aligned the
same way.  A gap without such words is settled by the longest common subsequence, which is again a longest increasing
subsequence over all equal pairs.  Coverage is the share of the template's words that are aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracklume.llm.text import blocks, word_hashes

# Short public license notices, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "BSD-line": "Released under the BSD License",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}
#: Of short notices, the phrases that decide which license it is: their first and last words must be aligned, without a foreign word between
#: them; a first word in brackets may be missing.  The notice is looked for around the first word of the first phrase that must be there.
DECIDING = {
    "Apache-2.0": ("apache", "license version 2 0"),
    "MIT": ("mit",),
    "BSD-line": ("bsd",),
    "GPL-2.0": ("(gnu) general public license version 2",),
    "GPL-3.0": ("(gnu) general public license version 3",),
    "LGPL-3.0": ("lesser general public license version 3",),
    "AGPL-3.0": ("affero general public license version 3",),
    "MPL-2.0": ("mozilla", "license v 2 0"),
    "CC-BY-4.0": ("attribution 4 0",),
    "CC-BY-4.0-line": ("cc by", "by 4 0"),
    "CC-BY-NC-4.0": ("cc by nc", "nc 4 0"),
    "CC-BY-SA-4.0": ("cc by sa", "sa 4 0"),
    "CC-BY-ND-4.0": ("cc by nd", "nd 4 0"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa", "sa 4 0"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd", "nd 4 0"),
}
SLACK = 16  # words without any of the template's that a stretch may hold in a row


def increasing(places: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    pile_of, back = [], []
    last: list[int] = []
    for i, x in enumerate(places):
        pile = bisect_left(tops, x)
        back.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(x)
            last.append(i)
        else:
            tops[pile] = x
            last[pile] = i
        pile_of.append(pile)
    out = []
    i = last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(template: Sequence[int], text: Sequence[int], at: int = 0, to: int | None = None, begin: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Aligned places (template, text), both ascending, of ``template[at:to]`` with ``text[begin:end]``."""
    out: list[tuple[int, int]] = []
    work = [(at, len(template) if to is None else to, begin, len(text) if end is None else end)]
    while work:
        at, to, begin, end = work.pop()
        while at < to and begin < end and template[at] == text[begin]:
            out.append((at, begin))
            at, begin = at + 1, begin + 1
        while at < to and begin < end and template[to - 1] == text[end - 1]:
            to, end = to - 1, end - 1
            out.append((to, end))
        if at >= to or begin >= end:
            continue
        mine, theirs = Counter(template[at:to]), Counter(text[begin:end])
        place = {w: j for j, w in enumerate(text[begin:end], begin) if mine.get(w) == 1 and theirs[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(template[at:to], at) if w in place]
        if pairs:
            pairs = [pairs[i] for i in increasing([j for _, j in pairs])]
            out += pairs
            edges = [(at - 1, begin - 1), *pairs, (to, end)]
            work += [(a + 1, b, c + 1, d) for (a, c), (b, d) in zip(edges[:-1], edges[1:], strict=True)]
        else:  # all equal pairs, the later ones of a word first, so that a word is used once
            where: dict[int, list[int]] = {}
            for j in range(end - 1, begin - 1, -1):
                if text[j] in mine:
                    where.setdefault(text[j], []).append(j)
            pairs = [(i, j) for i in range(at, to) for j in where.get(template[i], ())]
            out += [pairs[i] for i in increasing([j for _, j in pairs])]
    return sorted(out)


def dense_stretches(hits: Sequence[int]) -> list[tuple[int, int]]:
    """Ranges of ``hits`` (places of template words in a text) that may hold a dense run of them.

    A hit counts one up, a word between two hits one down.  A range ends where the count is used up or a gap is longer than ``SLACK``: no run of hits in which half of
    the words are hits reaches over such a place.
    """
    out, begin, count = [], 0, 1
    for i in range(1, len(hits)):
        gap = hits[i] - hits[i - 1] - 1
        count += 1 - gap
        if gap >= SLACK or count <= 0:
            out.append((begin, i))
            begin, count = i, 1
    return [*out, (begin, len(hits))] if hits else []


def densest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The run of aligned places with the most aligned words over foreign words between them: at least half of its words are aligned."""
    best, score, begin, count = (0, 0), 0, 0, 0
    for i, (_, j) in enumerate(pairs):
        foreign = j - pairs[i - 1][1] - 1 if i else 0
        if count - foreign <= 0:
            begin, count = i, 1
        else:
            count += 1 - foreign
        if count > score:
            best, score = (begin, i + 1), count
    return pairs[best[0] : best[1]]


def around(template: Sequence[int], text: Sequence[int], pivot: int, at: int, begin: int, end: int) -> list[tuple[int, int]]:
    """Aligned places with ``template[pivot]`` at ``text[at]``: the same words as in ``aligned``, each as near to the pivot as it can be."""
    begin, end = max(begin, at - (SLACK + 1) * pivot), min(end, at + 1 + (SLACK + 1) * (len(template) - pivot))
    out = [(pivot, at)]
    for pairs, step in ((aligned(template, text, 0, pivot, begin, at)[::-1], -1), (aligned(template, text, pivot + 1, len(template), at + 1, end), 1)):
        j = at
        for i, _ in pairs:
            last, j = j, j + step
            while text[j] != template[i]:
                j += step
            if abs(j - last) > SLACK:
                break
            out.append((i, j))
    return sorted(out)


def license_notices(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = 0.8, deciding: Mapping[str, Sequence[str]] = DECIDING) -> DataFrame:
    """Notices found in ``text``: ``doc_id``, ``license``, ``coverage``, ``matched`` words, ``start`` and ``stop`` (words, exclusive).

    Words are runs of ASCII letters, digits and non-ASCII bytes, with A-Z as a-z.  A text is cut into stretches that may hold a
    dense run of the template's words, with one at least every ``SLACK`` words; each is aligned with it.  A notice is the run of aligned words with the most of them over the
    foreign words between, so at least half of its words are the template's, however long the text is.  It is reported from ``coverage`` on, if it also holds the ``deciding`` phrases of its template or, for a template without such, one of the words that no other template
    has (where there are such words).  A phrase must be a part of its template.  Of notices that overlap, the one with more matched words stays,
    then the higher coverage, then the first name.  Null and empty texts hold none; an empty table, or no
    template, gives no row; repeated rows are reported as often as they occur; other columns are not read.

    A template is skipped for a text without the words to reach the coverage, which changes no result.
    """
    names = sorted(templates)
    words, before = word_hashes(pa.array([templates[n] for n in names], pa.string()), plain=True)
    listed = [words[a:b].tolist() for a, b in zip(before[:-1], before[1:], strict=True)]
    names, listed = [n for n, w in zip(names, listed, strict=True) if w], [w for w in listed if w]
    holders = Counter(w for ws in listed for w in set(ws))
    own = [{w for w in ws if holders[w] == 1} for ws in listed]

    phrases = []  # per template and phrase: places of its first word, of the first that must be there and of its last word
    for name, template in zip(names, listed, strict=True):
        told = list(deciding.get(name, ()))
        cells, at = word_hashes(pa.array(told, pa.string()), plain=True)
        parts = [cells[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        firsts = [next(i for i in range(len(template)) if template[i : i + len(p)] == p) for p in parts]
        phrases.append([(i, i + x.startswith("("), i + len(p) - 1) for i, x, p in zip(firsts, told, parts, strict=True)])

    def decided(pairs: list[tuple[int, int]], t: int) -> bool:
        place = dict(pairs)
        ends = [(a if a in place else first, first, b) for a, first, b in phrases[t]]
        return all(first in place and b in place and place[b] - place[a] + 1 == sum(a <= i <= b for i in place) for a, first, b in ends)

    def short_notices(text: list[int], t: int) -> Iterator[tuple]:
        template, pivot, begin = listed[t], phrases[t][0][1], 0
        for at in [j for j, w in enumerate(text) if w == template[pivot]]:
            pairs = densest(around(template, text, pivot, at, begin, len(text))) if at >= begin else []
            if len(pairs) / len(template) >= coverage and decided(pairs, t):
                begin = pairs[-1][1] + 1
                yield (names[t], len(pairs) / len(template), len(pairs), pairs[0][1], begin)

    def notices(text: list[int], t: int) -> Iterator[tuple]:
        if phrases[t]:
            yield from short_notices(text, t)
            return
        template = listed[t]
        known = set(template)
        hits = [i for i, w in enumerate(text) if w in known]
        for a, b in dense_stretches(hits):
            begin, end = hits[a], hits[b - 1] + 1
            while begin < end:  # a stretch may hold the notice more than once
                pairs = densest(aligned(template, text, begin=begin, end=end))
                # and without far-off words at its ends
                while len(pairs) > 1 and pairs[-1][1] - pairs[-2][1] > SLACK:
                    pairs.pop()
                while len(pairs) > 1 and pairs[1][1] - pairs[0][1] > SLACK:
                    pairs.pop(0)
                share = len(pairs) / len(template)
                if share < coverage or (own[t] and not any(template[i] in own[t] for i, _ in pairs)):
                    break
                yield (names[t], share, len(pairs), pairs[0][1], pairs[-1][1] + 1)
                begin = pairs[-1][1] + 1

    vocabulary = np.asarray(sorted(holders), np.uint64)
    weight = np.asarray([[ws.count(w) / len(ws) for ws in listed] for w in vocabulary.tolist()]).reshape(len(vocabulary), len(listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                words, before = word_hashes(block.column("text"), plain=True)
                rows = []
                if len(words) and len(vocabulary):
                    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                    hit = np.flatnonzero(vocabulary[at] == words)
                    bounds = np.searchsorted(hit, before)
                    keys = block.column("doc_id").to_pylist()
                    for row in np.flatnonzero(np.diff(bounds)).tolist():
                        present = np.unique(at[hit[bounds[row] : bounds[row + 1]]])
                        possible = np.flatnonzero(weight[present].sum(0) >= coverage - 1e-9)
                        if len(possible):
                            text = words[before[row] : before[row + 1]].tolist()
                            found = sorted((n for t in possible for n in notices(text, int(t))), key=lambda n: (-n[2], -n[1], n[0], n[3]))
                            kept: list[tuple] = []
                            for notice in found:
                                if all(notice[4] <= k[3] or notice[3] >= k[4] for k in kept):
                                    kept.append(notice)
                            rows += [(keys[row], *n) for n in sorted(kept, key=lambda n: n[3])]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license", "coverage", "matched", "start", "stop"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, matched long, start long, stop long")
