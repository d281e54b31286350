"""License scans by conditional compression.

Every template has a word without which its wording cannot be confirmed (its anchor). Around each such word of a text, however
its lines are wrapped, stands a candidate block: as many words as the template has. The block is compressed alone and with the
template as a raw zstandard dictionary; whichever template makes it ``GAIN`` bytes smaller is compared word by word with the text
there, and is confirmed if all of its telling words stand and few others are missing. Of grants that overlap, the one wins whose template
makes their common text smallest; every other grant is a row of its own. No template and no place is left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a template that must be found; a template of n words may have n + SLACK other words on each side of its anchor.
SHARE, SLACK, AFTER = 0.85, 16, 8
#: What a word of the template that is found counts, and what a word between costs: a far word is not fetched over a long gap.
FOUND, ADDED = 1000, 100
#: Bytes that a template must save on a candidate block (measured: 5 at least where the grant stands, 14 but for headings).
GAIN = 2
# Wording by which licenses are granted or referred to, and the words that tell one from another; after a ^ the
# wording must fill its line (a heading).
TEMPLATES = [
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("MIT", "without restriction sublicense sell", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "gnu general 3 later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "gnu general 2 later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "gnu lesser general 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "gnu affero general 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "redistribution neither name contributors", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "redistribution binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "bsd 3", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "bsd 2", "Licensed under the BSD 2-Clause License."),
    ("ISC", "purpose with or without fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "cc by 4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc by sa 4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "cc by nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "cc by nd 4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "cc by nc sa 4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "cc0 1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "creative commons attribution 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "unencumbered public domain", "This is free and unencumbered software released into the public domain."),
    ("MIT", "^ mit license", "MIT License"),
    ("MIT", "^ mit license", "The MIT License (MIT)"),
    ("ISC", "^ isc license", "ISC License"),
    ("BSD-2-Clause", "^ bsd 2 clause license", "BSD 2-Clause License"),
    ("BSD-3-Clause", "^ bsd 3 clause license", "BSD 3-Clause License"),
    ("Apache-2.0", "apache license 2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "gnu general public license 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "gnu general public license 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "gnu lesser general public license 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "gnu affero general public license 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "^ mozilla public license 2.0", "Mozilla Public License Version 2.0"),
]
# Identifiers of the SPDX list.
SPDX = "MIT ISC Unlicense 0BSD Zlib BSD-2-Clause BSD-3-Clause Apache-2.0 MPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-2.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0".split()
TEMPLATES += [(name, f"spdx license identifier {name.lower().replace('-', ' ')}", f"SPDX-License-Identifier: {name}") for name in SPDX]
#: Words that a grant may not have beyond its template's, in it or in the AFTER words that end its sentence: they name another license.
TELLING = {"nc", "nd", "sa", "lesser", "affero", "later", "only", "2.0", "1.0", "2.1", "3.0", "4.0", "2", "3", "0"}
_WORD = re.compile(r"\d+(?:\.\d+)+|[^\W_]+")
_END = re.compile(r"[.!?][\"')\]]*\s|\n[^\S\n]*\n")
_LISTED = re.compile(r"(?:^[\s*#/;(-]*|[.:;]\s+\(?)(\d+)[.)]\s", re.MULTILINE)
_BAD = -(10**12)


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _needed(want: list[str], must: set[str]) -> str:
    """The longest word without which a template is not confirmed: one that must stand, or whose loss leaves too few."""
    return max((w for w in want if w in must or len(want) - want.count(w) < SHARE * len(want)), key=len)


def _side(want: list[str], must: set[str], words: list[str], barred: list[bool]) -> tuple[int, list[int], list[int]] | None:
    """The best way to find ``want`` in order from the start of ``words``: (words used, numbers of the words of ``want`` that
    are missing, numbers of the words that are added); None if a word of ``must`` cannot be found. Words found count FOUND, words
    added cost ADDED; words after the last one found are not used, and barred ones are never passed over."""
    n, m = len(want), len(words)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for j in range(m):
        best[0][j + 1] = _BAD if barred[j] else best[0][j] - ADDED
    for i in range(n):
        old, row, w = best[i], best[i + 1], want[i]
        lost = _BAD if w in must else 0
        row[0] = old[0] + lost
        for j in range(m):
            x = max(old[j + 1] + lost, row[j] + (_BAD if barred[j] else -ADDED))
            if words[j] == w and old[j] + FOUND > x:
                x = old[j] + FOUND
            row[j + 1] = x
    used = max(range(m + 1), key=lambda j: (best[n][j], -j))
    if best[n][used] < _BAD // 2:
        return None
    i, j, missing, added = n, used, [], []
    while i or j:
        if i and j and words[j - 1] == want[i - 1] and best[i][j] == best[i - 1][j - 1] + FOUND:
            i, j = i - 1, j - 1
        elif i and best[i][j] == best[i - 1][j] + (_BAD if want[i - 1] in must else 0):
            i -= 1
            missing.append(i)
        else:
            j -= 1
            added.append(j)
    return used, missing[::-1], added[::-1]


def _apart(spans: list[tuple]) -> list[tuple]:
    """The spans (first word, end, ...), taken in order, that overlap none taken before."""
    taken: list[tuple] = []
    starts: list[int] = []
    for s in spans:
        at = bisect_left(starts, s[0])
        if (at == 0 or taken[at - 1][1] <= s[0]) and (at == len(taken) or s[1] <= taken[at][0]):
            starts.insert(at, s[0])
            taken.insert(at, s)
    return taken


class Scanner:
    """Templates as dictionaries, with their words."""

    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES, gain: float = GAIN) -> None:
        self.gain = gain
        self.templates = [(name, set(must.split()) - {"^"}, _words(text), self._press(" ".join(_words(text)))) for name, must, text in templates]
        self.heading = [must.startswith("^") for _, must, _ in templates]
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.opening = {tuple(want[:2]) for _, _, want, _ in self.templates}
        self.anchors: dict[str, list[int]] = defaultdict(list)
        for k, (_, must, want, _) in enumerate(self.templates):
            self.anchors[_needed(want, must)].append(k)
        #: Found in every text that has a grant, as each template's anchor is.
        self.hint = rf"(?i)(?<![a-z])(?:{'|'.join(re.escape(w) for w in sorted(self.anchors))})(?![a-z])"

    @staticmethod
    def _press(text: str) -> zstandard.ZstdCompressor:
        raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)

    def _sizes(self, k: int, words: list[str]) -> tuple[int, int]:
        """Bytes of some words compressed alone and with template ``k`` as dictionary."""
        data = " ".join(words).encode("utf-8", "replace")
        return len(self.alone.compress(data)), len(self.templates[k][3].compress(data))

    def _reduction(self, k: int, words: list[str]) -> float:
        alone, given = self._sizes(k, words)
        return 1 - given / alone

    def _confirm(self, k: int, anchor: str, at: int, words: list[str], barred: list[bool]) -> tuple | None:
        """(first word, end, template, kept words, missing, added) of the grant whose anchor is word ``at``."""
        _, must, want, _ = self.templates[k]
        n, j = len(want), want.index(anchor)
        lo, hi = max(0, at - j - n - SLACK), min(len(words), at + 2 * n - j + SLACK)
        near = words[lo:hi]
        there = set(near)
        if not must <= there or sum((Counter(want) & Counter(near)).values()) < SHARE * n:
            return None
        alone, given = self._sizes(k, words[max(0, at - j) : at - j + n])
        if alone - given < self.gain:
            return None
        left = _side(want[:j][::-1], must, words[lo:at][::-1], barred[lo:at][::-1])
        right = left and _side(want[j + 1 :], must, words[at + 1 : hi], barred[at + 1 : hi])
        if not right:
            return None
        kept = n - len(left[1]) - len(right[1])
        if kept < SHARE * n:
            return None
        missing = [want[j - 1 - i] for i in reversed(left[1])] + [want[j + 1 + i] for i in right[1]]
        added = [words[at - 1 - i] for i in reversed(left[2])] + [words[at + 1 + i] for i in right[2]]
        return at - left[0], at + 1 + right[0], k, kept, missing, added

    def scan(self, text: str) -> list[tuple[int, str, float, float, list[str], list[str]]]:
        """(line, license, size reduction, share of the template's words found, words missing, words added) of every grant."""
        found = list(_WORD.finditer(text))
        words = [m[0].lower() for m in found]
        listed = {m.start(1) for m in _LISTED.finditer(text)}
        barred = [w in TELLING and m.start() not in listed for w, m in zip(words, found, strict=True)]

        def ends_another(end: int) -> bool:
            for i in range(end, min(end + AFTER, len(words))):
                if found[i][0] in ("OR", "AND", "WITH") or _END.search(text, found[i - 1].end(), found[i].start()) or tuple(words[i : i + 2]) in self.opening:
                    return False
                if barred[i]:
                    return True
            return False

        def fills_line(first: int, end: int) -> bool:
            before = first == 0 or "\n" in text[found[first - 1].end() : found[first].start()]
            return before and (end == len(words) or "\n" in text[found[end - 1].end() : found[end].start()])

        by_template: dict[int, set] = defaultdict(set)
        spans: dict[tuple, tuple] = {}
        for at, w in enumerate(words):
            for k in self.anchors.get(w, ()):
                if (s := self._confirm(k, w, at, words, barred)) and not ends_another(s[1]) and (not self.heading[k] or fills_line(*s[:2])):
                    by_template[k].add(s[:4])
                    spans[s[:3]] = s
        grants = []
        for some in by_template.values():
            grants += [spans[s[:3]] for s in _apart(sorted(some, key=lambda s: (-s[3], s[1] - s[0], s[0])))]
        rows, group, end = [], [], 0
        lines = [m.start() for m in re.finditer("\n", text)]

        def close() -> None:
            block = words[group[0][0] : end]
            ranked = sorted(group, key=lambda s: (-self._reduction(s[2], block), -s[3], s[2])) if len(group) > 1 else group
            for a, b, k, kept, missing, added in _apart(ranked):
                name, _, want, _ = self.templates[k]
                rows.append((bisect_left(lines, found[a].start()), name, self._reduction(k, words[a:b]), kept / len(want), missing, added))

        for s in sorted(grants, key=lambda s: s[:3]):
            if group and s[0] >= end:
                close()
                group = []
            end = max(end, s[1]) if group else s[1]
            group.append(s)
        if group:
            close()
        return rows


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, line, license, reduction, share, missing, added), a row for each grant at the line where
    it starts, also where a line has several.

    Of grants that overlap and whose templates save equally much, the one with more words found is reported, then the template
    that is listed first. Null and empty texts have none; texts and lines of any length are scanned whole, in time by their
    candidate blocks, which are bounded; repeated rows are scanned each; null doc_ids stay; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(doc_id, *r) for r in scanner.scan(text)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "line", "license", "reduction", "share", "missing", "added"])

    near = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike(Scanner(templates).hint))
    return near.mapInArrow(run, "doc_id long, line int, license string, reduction double, share double, missing array<string>, added array<string>")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
