"""License scans by patience alignment (operator 2)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_or_lowest, id_or_null

#: Share of a template's words that must align.
LEAST_COVERAGE = 0.8
#: Texts are aligned within this many template lengths around a word.
REACH = 2

# Notices of public licences, as their authors publish them.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_WORD = re.compile(r"[0-9a-z]+(?:[.-][0-9a-z]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs (in order of the first) in which the second grows."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[k], ends[k] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str], a0: int = 0, a1: int | None = None, b0: int = 0, b1: int | None = None) -> list[tuple[int, int]]:
    """Patience alignment of a[a0:a1] with b[b0:b1]: matched positions, growing in both.

    Equal ends are taken off first; words that occur once in either part are anchors if they lie on a longest
    increasing subsequence; the gaps between anchors are aligned in the same way.
    """
    a1, b1 = len(a) if a1 is None else a1, len(b) if b1 is None else b1
    out, todo = [], [(a0, a1, b0, b1)]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        na, nb = Counter(a[i0:i1]), Counter(b[j0:j1])
        where = {b[j]: j for j in range(j0, j1) if nb[b[j]] == 1}
        anchors = _increasing([(i, where[a[i]]) for i in range(i0, i1) if na[a[i]] == 1 and a[i] in where])
        if not anchors:
            continue
        out += anchors
        last = (i0 - 1, j0 - 1)
        for i, j in [*anchors, (i1, j1)]:
            todo.append((last[0] + 1, i, last[1] + 1, j))
            last = (i, j)
    return sorted(out)


def scan_text(text: str | None, templates: dict[str, list[str]], least: float = LEAST_COVERAGE) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first word, last word) of the best place of each template that reaches the coverage.

    A text that lacks too many of a template's words cannot reach it, which spares most alignments and loses
    none. Around each place of the template's rarest word in the text, a window is aligned, so an alignment
    never gathers words from all over a long text; and a part of it that holds that word no more often than the
    template does, as a window may hold a notice twice. If that word is one of those missing, the next rarest serve:
    as many of them as may be missing, and one more. Every place is tried, so time grows with how often that word
    stands in the text, and with the template's length.
    """
    if not text:
        return []
    words = words_of(text)
    have = Counter(words)
    out = []
    places: dict[str, list[int]] | None = None
    for name, template in templates.items():
        n = len(template)
        spare = n - -int(-least * n // 1)  # words that may be missing
        need = Counter(template)
        if sum(max(0, k - have[w]) for w, k in need.items()) > spare:
            continue
        if places is None:
            places = {}
            for i, w in enumerate(words):
                places.setdefault(w, []).append(i)
        rarest, best = sorted((have[w], w) for w in need if have[w]), (0.0, 0, 0)
        for tried, (_, w) in enumerate(rarest):
            if tried > spare or best[0] >= 1:
                break
            for i, at in enumerate(places[w]):
                lo, hi = max(0, at - REACH * n), min(len(words), at + REACH * n + 1)
                for lo, hi in [*_cuts(places[w], i, need[w], lo, hi), (lo, hi)]:
                    if hi - lo < least * n or hi - lo <= best[0] * n:
                        continue
                    pairs = _dense(align(words, template, lo, hi), n)
                    if pairs and len(pairs) / n > best[0]:
                        best = (len(pairs) / n, pairs[0][0], pairs[-1][0])
        if best[0] >= least:
            out.append((name, *best))
    return sorted(out, key=lambda x: (-x[1] * len(templates[x[0]]), x[0]))


def _cuts(places: list[int], i: int, times: int, lo: int, hi: int) -> list[tuple[int, int]]:
    """Windows within lo and hi that hold a word from its i-th place on as often as a template does, or less often.

    Where a notice stands twice, all its words do, and nothing anchors it; of such a window the word itself does.
    """
    first = max(lo, places[i - 1] + 1) if i else lo
    ends = [min(hi, places[k]) if k < len(places) else hi for k in range(i + 1, i + times + 1)]
    return [(first, end) for end in dict.fromkeys(ends) if (first, end) != (lo, hi)]


def _dense(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The longest run of pairs that spans at most REACH template lengths of text."""
    best, lo = [], 0
    for hi in range(len(pairs)):
        while pairs[hi][0] - pairs[lo][0] >= REACH * n:
            lo += 1
        if hi - lo + 1 > len(best):
            best = pairs[lo : hi + 1]
    return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, license (best match or null), coverage, first_word, last_word, licenses (all): a row for each row of docs.

    Best is the template with the most aligned words; ties go to the smaller name. Null and empty texts hold
    no licence; a null id stays null; repeated rows are scanned each; extra columns are not read; of an empty table
    there is no row. Texts are scanned whole, however long; a task holds the words of one at a time.
    """
    split = {k: words_of(v) for k, v in sorted((templates or TEMPLATES).items())}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan_text(t, split, least) for t in b.column("text").to_pylist()]
            best = [f[0] if f else (None, 0.0, None, None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array([x[0] for x in best], pa.string()), pa.array([float(x[1]) for x in best], pa.float64()), pa.array([x[2] for x in best], pa.int32()), pa.array([x[3] for x in best], pa.int32()), pa.array([[x[0] for x in f] for f in found], pa.list_(pa.string()))],
                ["_id", "license", "coverage", "first_word", "last_word", "licenses"],
            )

    out = docs.select(id_or_lowest("doc_id").alias("_id"), "text").mapInArrow(scan, "_id long, license string, coverage double, first_word int, last_word int, licenses array<string>")
    return out.withColumn("doc_id", id_or_null("_id")).select("doc_id", "license", "coverage", "first_word", "last_word", "licenses")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
