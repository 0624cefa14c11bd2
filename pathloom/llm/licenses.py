"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

A match is charged for both what it lacks and what it has too much: coverage is the share of matched words in the template or in the
span, whichever is longer. Words that tell licenses apart (numbers and TELLING) must agree: one that the span lacks, or has
besides, is another license's.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, utf8

K, WINDOW = 3, 2
#: Templates of fewer words must match in full, without other words between; of longer ones this share of the words.
SHORT, COVERAGE = 10, 0.8
#: Words by which names of licenses differ.
TELLING = frozenset(b"affero lesser library noncommercial noderivatives noderivs sharealike nc nd sa by zero cc0 clause apache mozilla eclipse european academic artistic boost".split())
#: Bytes of templates, which go to every task.
TEMPLATE_BYTES = 32 << 20
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

#: License notices, by SPDX identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": [
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    ],
    "CC0-1.0": [
        "Licensed under CC0 1.0",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under the CC0 1.0 Universal Public Domain Dedication",
    ],
}


def _gnu() -> dict[str, list[str]]:
    """Notices of the GNU licenses, which differ by name, number and a mark."""
    names = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}
    out = {}
    for short, numbers in (("GPL", ("1", "2", "3")), ("LGPL", ("2", "2.1", "3")), ("AGPL", ("3",))):
        for n in numbers:
            name = f"GNU {'Library General' if (short, n) == ('LGPL', '2') else names[short]} Public License"
            program, mark = ("library" if short == "LGPL" else "program"), ":" if n == "3" else ";"
            out[f"{short}-{n if '.' in n else n + '.0'}"] = [
                f"This work is licensed under the {name}, version {n}",
                f"This {program} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{',' if n == '3' else ';'} either version {n} of the License, or (at your option) any later version.",
            ]
    return out


def _creative_commons() -> dict[str, list[str]]:
    """Notices of the Creative Commons licenses: each set of terms that there is, each version."""
    words = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
    out = {}
    for terms in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        name = "-".join(words[t] for t in terms.split("-"))
        for version in ("2.0", "3.0", "4.0"):
            place = {"4.0": "International", "3.0": "Unported", "2.0": "Generic"}[version]
            out[f"CC-{terms}-{version}"] = [f"Licensed under CC {terms} {version}", f"This work is licensed under a Creative Commons {name} {version} {place} License"]
    return out


TEMPLATES |= _gnu() | _creative_commons()


def words_of(text: bytes) -> list[bytes]:
    """Words of letters and digits, A-Z lower-cased; every byte from 0x80 on is a letter's."""
    return text.translate(_TABLE).split()


def placed(text: bytes) -> list[tuple[int, int]]:
    """(start, stop) in bytes of each of words_of(text)."""
    return [m.span() for m in re.finditer(rb"[^\x20]+", text.translate(_TABLE))]


def _hash(shingle: tuple[bytes, ...]) -> int:
    return zlib.crc32(b" ".join(shingle))


def winnow(words: list[bytes], k: int = K, window: int = WINDOW) -> list[tuple[int, tuple[bytes, ...]]]:
    """(place, shingle) of the chosen fingerprints: the lowest hash of each `window` shingles in a row, the last on ties."""
    k = min(k, len(words))
    shingles = list(zip(*(words[j:] for j in range(k)), strict=False)) if k else []
    h = [_hash(s) for s in shingles]
    out = {}
    for i in range(max(1, len(h) - window + 1) if h else 0):
        at = min(range(i, min(len(h), i + window)), key=lambda j: (h[j], -j))
        out[at] = shingles[at]
    return sorted(out.items())


class Index:
    """Inverted index: shingle -> (template, place) of its winnowed fingerprints."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names, self.words = [], []
        self.places: dict[tuple[bytes, ...], list[tuple[int, int]]] = defaultdict(list)
        for name, texts in templates.items():
            for t in texts:
                words = words_of(t.encode())
                if words:
                    for at, s in winnow(words):
                        self.places[s].append((len(self.words), at))
                    self.names.append(name)
                    self.words.append(words)
        self.places = dict(self.places)
        self.widths = sorted({len(s) for s in self.places})

    def scan(self, text: bytes) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, start, stop, matched words) of each match, in order; bytes. Of overlapping matches the one with more matched words stays."""
        words = words_of(text)
        hits = defaultdict(list)
        for k in self.widths:
            for i, s in enumerate(zip(*(words[j:] for j in range(k)), strict=False)):
                if s in self.places:
                    for template, at in self.places[s]:
                        hits[template].append((i, at))
        found = []
        for template, pairs in hits.items():
            t = self.words[template]
            band = 4 + len(t) // 8
            for low, high in _regions(pairs, len(t), band, len(words)):
                pairs_of = aligned(t, words, low, high)
                if pairs_of:
                    start, stop, matched = pairs_of[0][1], pairs_of[-1][1] + 1, len(pairs_of)
                    coverage = matched / max(len(t), stop - start)
                    if coverage >= (1 if len(t) < SHORT else COVERAGE) and same_telling(t, words, pairs_of):
                        found.append((matched, coverage, start, stop, template))
        if not found:
            return []
        place = placed(text)
        found = [f for f in found if not _goes_on(text, words, place, f[3])]
        taken, out = [], []
        for matched, coverage, start, stop, template in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[4])):
            if all(stop <= a or start >= b for a, b in taken):
                taken.append((start, stop))
                out.append((start, stop, self.names[template], coverage, matched))
        return [(name, coverage, place[a][0], place[b - 1][1], matched) for a, b, name, coverage, matched in sorted(out)]


def _regions(pairs: list[tuple[int, int]], length: int, band: int, n: int) -> list[tuple[int, int]]:
    """(low, high): ranges of diagonals (place in text less place in template) in which hits lie, band wide at most apart."""
    diagonals = sorted({i - at for i, at in pairs})
    out = [[diagonals[0], diagonals[0]]]
    for d in diagonals[1:]:
        if d - out[-1][1] <= band and d - out[-1][0] <= length:
            out[-1][1] = d
        else:
            out.append([d, d])
    return [(low - band, high + band) for low, high in out]


def aligned(t: list[bytes], words: list[bytes], low: int, high: int) -> list[tuple[int, int]]:
    """(place in t, place in words) of the matched words of the best local alignment of t inside the band of diagonals low to high.

    A match is worth 2, a mismatch or a word left out costs 1; of equal scores the most matches, then the first end. Rows are template words;
    only the band's cells are filled, and each remembers where it came from: 1 diagonal, 2 from above, 3 from the left, 0 a start.
    """
    width = high - low + 1
    before = [(0, 0)] * (width + 1)  # (score, matched)
    best, at, came = (0, 0), None, []
    for r, w in enumerate(t):
        now, moves = [], bytearray(width)
        for c in range(width):
            j = r + low + c
            if not 0 <= j < len(words):
                now.append((0, 0))
                continue
            score, matched = before[c]  # the diagonal before
            cell, move = ((score + 2, matched + 1) if w == words[j] else (score - 1, matched)), 1
            up, left = before[c + 1], now[-1] if now else (0, 0)
            if (up[0] - 1, up[1]) > cell:
                cell, move = (up[0] - 1, up[1]), 2
            if (left[0] - 1, left[1]) > cell:
                cell, move = (left[0] - 1, left[1]), 3
            if cell[0] <= 0:
                cell, move = (0, 0), 0
            elif cell > best:
                best, at = cell, (r, c)
            now.append(cell)
            moves[c] = move
        before = [*now, (0, 0)]
        came.append(moves)
    out = []
    while at is not None:
        r, c = at
        move = came[r][c] if r >= 0 and 0 <= c < width else 0
        if move == 1:
            if t[r] == words[r + low + c]:
                out.append((r, r + low + c))
            at = (r - 1, c)
        elif move == 2:
            at = (r - 1, c + 1)
        elif move == 3:
            at = (r, c - 1)
        else:
            at = None
    return out[::-1]


def _telling(word: bytes) -> bool:
    return word in TELLING or word.isdigit()


def same_telling(t: list[bytes], words: list[bytes], pairs: list[tuple[int, int]]) -> bool:
    """Whether all words of t that tell licenses apart are matched, and the span has none besides but numbers of lists and years.

    Numbers besides count where the template has one next to them: `version 2 1` isn't `version 2`.
    """
    mine, theirs = {i for i, _ in pairs}, {j for _, j in pairs}
    if any(_telling(w) and i not in mine for i, w in enumerate(t)):
        return False
    for j in range(pairs[0][1], pairs[-1][1] + 1):
        if j not in theirs and (words[j] in TELLING or words[j].isdigit() and (j - 1 in theirs and words[j - 1].isdigit() or j + 1 in theirs and words[j + 1].isdigit())):
            return False
    return True


def _goes_on(text: bytes, words: list[bytes], place: list[tuple[int, int]], stop: int) -> bool:
    """Whether the span ends in the middle of a number: `version 2` before `.1`."""
    end = place[stop - 1][1]
    return words[stop - 1].isdigit() and text[end : end + 1] == b"." and text[end + 1 : end + 2].isdigit()


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, matches) for each row of docs: matches has (license, coverage, start, stop, words) in the text's order.

    start and stop are code points from 0, stop exclusive; words: how many of the template's words match. The templates are
    a parameter that goes to every task, TEMPLATE_BYTES of them at most; texts of any length are read whole. A null or empty text has no matches.
    Of overlapping matches that with more matched words stays, then the one with more coverage, the first place and the first template.
    Repeated rows stay, an empty table gives an empty one, other columns are not looked at.
    """
    if sum(len(t.encode()) for texts in templates.values() for t in texts) > TEMPLATE_BYTES:
        raise ValueError(f"templates have more than {TEMPLATE_BYTES} bytes")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int64())]))

    def make():
        index = Index(shared.value)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t in utf8(b.column(1)):
                found = index.scan(t or b"")
                out.append([{"license": n, "coverage": c, "start": len(t[:s].decode()), "stop": len(t[:e].decode()), "words": m} for n, c, s, e, m in found])
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["id", "matches"])

        return one

    return by_batch(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, matches array<struct<license:string,coverage:double,start:long,stop:long,words:long>>")
