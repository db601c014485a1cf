"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of A-Z, a-z and 0-9 in lower case; shingles have five words. A template of n shingles is looked for in
windows of 2L shingles that overlap by L, where L is the least power of two that is at least n: so some window holds
any place of the template whole. A window that contains the share c of a template has c n shingles with it in common,
and their union has at most 2L + (1 - c) n < (5 - c) n: a Jaccard similarity above c / (5 - c). BANDS bands of one row
each collide with a chance of 1 - (1 - c / (5 - c))^BANDS: above 0.999998 for c = 0.8. Templates found so are verified:
the share of their shingles in the window, by 64-bit hashes, must reach `least`; overlapping finds of a template are one
match. A find inside that of a larger template, most of which the smaller one is a part of, goes with the larger
(a note inside a whole notice, two clauses inside three).

A row-local operator: one Arrow pass over whole texts; the templates are the only data that every task holds.

Defined results: a null or empty text has no matches (and no rows); repeated rows match each; other columns are not
read; templates of under five words are refused; no rows in, no rows out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, hash_array, map_arrow, word_hashes

SHINGLE, BANDS, LEAST = 5, 64, 0.8
SCHEMA = "doc_id bigint, license string, start int, end int, containment double"
WORDS = re.compile(rb"[a-z0-9]+")
PLACES = re.compile(r"[A-Za-z0-9]+")

#: Texts and notices of public licences; names that end in -note are one-line notices.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_CLAUSE_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HOLDERS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_HOPE = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
TEMPLATES = {
    "MIT": f"{_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MIT-grant": _GRANT,
    "MIT-note": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-note": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program {_HOPE} See the GNU General Public License for more details.",
    "GPL-3.0": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program {_HOPE} See the GNU General Public License for more details.",
    "GPL-3.0-note": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library {_HOPE} See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program {_HOPE} See the GNU Affero General Public License for more details.",
    "BSD-2-Clause": f"{_REDISTRIBUTION} {_HOLDERS}",
    "BSD-3-Clause": f"{_REDISTRIBUTION} {_CLAUSE_3} {_HOLDERS}",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL-2.0-note": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-NC-4.0-note": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

_ODD = np.random.default_rng(4).integers(0, 1 << 31, (BANDS, 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(raw: bytes) -> np.ndarray:
    words = WORDS.findall(raw.lower())
    return gram_hashes(hash_array(words, word_hashes()), SHINGLE) if len(words) >= SHINGLE else np.empty(0, np.uint64)


def _rows(s: np.ndarray) -> np.ndarray:
    """(BANDS, n) of 32-bit hashes of shingles, one permutation in each row."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    return low[None, :] * _ODD[:, :1] + _ODD[:, 1:]


@lru_cache(4)
def prepared(templates: tuple[tuple[str, str], ...], least: float = LEAST) -> tuple[dict[int, list[tuple[str, np.ndarray, np.ndarray]]], dict[str, set[str]]]:
    """(by window class L: (name, sorted shingles, band values); the larger templates that each one is a part of)."""
    out: dict[int, list] = {}
    sets = {}
    for name, text in templates:
        s = sets[name] = np.unique(shingles(text.encode()))
        if not len(s):
            raise ValueError(f"a template needs {SHINGLE} words: {name}")
        out.setdefault(1 << (len(s) - 1).bit_length(), []).append((name, s, _rows(s).min(axis=1)))
    part_of = {a: {b for b in sets if len(sets[b]) > len(sets[a]) and np.isin(sets[a], sets[b]).mean() >= least} for a in sets}
    return out, part_of


def matches(raw: bytes, classes: tuple, least: float = LEAST, bands: bool = True) -> list[tuple[str, int, int, float]]:
    """(name, first word, word after the last, containment), by name and place. Without bands every window is verified."""
    by_length, part_of = classes
    s = shingles(raw)
    n, found = len(s), []
    if not n:
        return []
    block, size = _rows(s), 1
    for length in range(max(by_length).bit_length()):
        if length:  # minima of blocks of twice the size
            if block.shape[1] % 2:
                block = np.concatenate([block, np.full((BANDS, 1), 0xFFFFFFFF, np.uint32)], axis=1)
            block, size = np.minimum(block[:, ::2], block[:, 1::2]), size * 2
        if size not in by_length:
            continue
        windows = np.minimum(block, np.concatenate([block[:, 1:], block[:, -1:]], axis=1))
        for name, own, values in by_length[size]:
            spans: list[list] = []
            alike = (windows == values[:, None]).any(axis=0) if bands else np.ones(windows.shape[1], bool)
            for w in np.flatnonzero(alike).tolist():
                part = s[w * size : (w + 2) * size]
                hit = np.isin(part, own)
                share = len(np.unique(part[hit])) / len(own)
                if share >= least:
                    at = np.flatnonzero(hit)
                    a, b = w * size + int(at[0]), w * size + int(at[-1]) + SHINGLE
                    if spans and a < spans[-1][1]:
                        spans[-1][1:] = [max(b, spans[-1][1]), max(share, spans[-1][2])]
                    else:
                        spans.append([a, b, share])
            found += [(name, a, b, share) for a, b, share in spans]
    inside = lambda x, y: y[0] in part_of[x[0]] and y[1] <= x[1] and x[2] <= y[2]
    return sorted(x for x in found if not any(inside(x, y) for y in found))


def _scan(templates: tuple, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        classes = prepared(templates, least)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = matches(text.encode(), classes, least) if text else []
                if got:
                    places = [m.span() for m in PLACES.finditer(text)]
                    out += [(doc_id, name, places[a][0], places[b - 1][1], share) for name, a, b, share in got]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "license", "start", "end", "containment"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each match: doc_id, license, start and end in code points, and the share of the template's shingles."""
    t = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_arrow(t, _scan(tuple(sorted((templates or TEMPLATES).items())), least), SCHEMA)
