"""License scans by patience alignment of template notices.

Words that occur once in both text and template are anchors; the longest increasing subsequence of their positions is
kept, and the gaps between kept anchors are aligned the same way, down to gaps without common unique words, where equal
words at both ends are matched. Coverage is the matched share of the template's words. A text may hold a notice several
times, or far more text than the notice, so that a word unique in the template repeats in the text: alignment therefore
runs in windows around occurrences of the template's rarest words, and windows are joined where they overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches

# fixed values: short notices as the licenses' own texts recommend them
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
# fixed values: common English words, which tell little about a notice
COMMON = set("a all also an and any are as at be been but by can do even for form from had has have if in into is it its later list made may more must not of on one only or other see shall so than that the their then there these they this to under use was we were which who will with work would you your v kind law basis including provided persons general purpose particular required useful hope subject writing express option".split())
WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")
COVERAGE = 0.8


def words(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lower-cased words with their starts and ends in the text; a word is a run of ASCII letters and digits, or a version number."""
    found = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience piles with back links."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text, template) positions, both ascending."""
    matched, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if there[w] == 1 and here[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place]
        if not anchors:
            continue
        kept = [anchors[i] for i in increasing([j for _, j in anchors])]
        matched.extend(kept)
        for (i, j), (k, m) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)]):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(matched)


class Scanner:
    """Templates prepared once; ``scan`` finds all their notices in a text."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = {name: words(t)[0] for name, t in templates.items()}
        spread = Counter(w for t in self.templates.values() for w in set(t))
        # any text that covers a template holds one of so many of its words; the most telling ones are looked for
        self.keys: dict[str, set[str]] = {}
        for name, t in self.templates.items():
            distinct = sorted(set(t), key=lambda w: (w in COMMON, spread[w], -len(w), w))
            # however the missing words fall, one of these is left; what is needed is told by the comparison that scan makes
            needed = next((n for n in range(len(t)) if n / len(t) >= coverage), len(t))
            self.keys[name] = set(distinct[: len(t) - needed + 1])
        self.wanted = set().union(*self.keys.values())

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end) in code points, by start; the best of overlapping finds is kept."""
        w, starts, ends = words(text)
        at = defaultdict(list)
        for i, x in enumerate(w):
            if x in self.wanted:
                at[x].append(i)
        found = []
        for name, template in self.templates.items():
            hits = sorted({i for k in self.keys[name] if k in at for i in at[k]})
            last, reach = -1, len(template) + len(template) // 2
            groups: list[list[int]] = []
            for i in hits:
                if groups and i - groups[-1][1] <= len(template):
                    groups[-1][1] = i
                else:
                    groups.append([i, i])
            for lo, hi in groups:
                a, end = max(0, lo - reach, last + 1), min(len(w), hi + reach)
                while a < end:
                    # a group may hold several notices: half a template more than one at a time
                    b = min(end, a + reach)
                    pairs = align(w[a:b], template)
                    pairs = _densest(pairs, reach)
                    share = len(pairs) / len(template)
                    if share >= self.coverage:
                        first, final = a + pairs[0][0], a + pairs[-1][0]
                        found.append((name, share, starts[first], ends[final], final - first))
                        a, last = final + 1, final
                    elif b == end:
                        break
                    else:
                        a += max(1, reach // 6)
        # kept finds lie apart, in order: only the neighbours of a place can overlap a new one
        kept: list[tuple[int, int, str, float]] = []
        for name, share, s, e, _ in sorted(found, key=lambda f: (-(f[3] - f[2]) * f[1], f[2], f[0])):
            i = bisect_left(kept, (s,))
            if (i == 0 or kept[i - 1][1] <= s) and (i == len(kept) or kept[i][0] >= e):
                kept.insert(i, (s, e, name, share))
        return [(name, share, s, e) for s, e, name, share in kept]


def _densest(pairs: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """The most matches that fit in ``reach`` words of text; the first of equal ones."""
    best, lo = (0, 0), 0
    for hi in range(len(pairs)):
        while pairs[hi][0] - pairs[lo][0] >= reach:
            lo += 1
        if hi + 1 - lo > best[1] - best[0]:
            best = (lo, hi + 1)
    return pairs[best[0] : best[1]]


def license_spans(documents: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, n_licenses, licenses, coverage, spans): one row per row of ``documents``.

    spans is a list of (license, coverage, start, end) by start, in code points, end exclusive; coverage the greatest of
    them, 0.0 without any, which is also the result for null and empty texts. A native test for the words that every
    match needs comes first, so that texts without them never reach Python.
    """
    scanner = Scanner(templates, coverage)
    sure = "(?i)(?<![A-Za-z0-9])(?:" + "|".join(re.escape(w) for w in sorted(scanner.wanted)) + ")(?![A-Za-z0-9])"
    span = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    text = F.when(F.col("text").rlike(sure), F.col("text"))

    def run(source):
        for batch in batches(source):
            rows = [[{"license": n, "coverage": c, "start": s, "end": e} for n, c, s, e in scanner.scan(t)] if t else [] for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    kept = documents.select("doc_id", text.alias("text"))
    found = kept.mapInArrow(run, T.StructType([kept.schema["doc_id"], T.StructField("spans", span)]))
    return found.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.col("spans.license"))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.col("spans.coverage")), F.lit(0.0)).alias("coverage"),
        "spans",
    )
