"""License scans: MinHash bands retrieve templates, shingle containment verifies them.

A text that holds enough of a template's shingles at all is read in overlapping windows, one from every word, as long as a template. A
window's MinHash signature is cut into bands; a template that agrees in a band is
retrieved, and the match is verified by the exact share of the template's shingles in
the window. A window that contains 0.8 of a template has a similarity of 2/3 at least;
`miss_probability` says how rarely such a window agrees in no band (under 1e-5).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import mix, shingle_hashes, slices, text_buffer, word_bounds, word_hashes

SHINGLE = 2
BANDS, ROWS = 20, 2
CONTAINED = 0.8

_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)

#: License notices and texts, as published, by SPDX identifier. No entry may
#: look like another: what holds 0.8 of a template is taken for it.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_3 + _AS_IS),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)

#: Letters, digits and all bytes beyond ASCII make words.
_MARK = np.ones(256, dtype=bool)
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = _MARK[128:] = False


def miss_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    return (1 - similarity**rows) ** bands


@dataclass
class Template:
    name: str
    shingles: np.ndarray
    signature: np.ndarray
    width: int


def _minima(shingles: np.ndarray, width: int) -> np.ndarray:
    """Sliding minima of runs of `width`: two overlapping runs of a power of two."""
    reach = 1
    while 2 * reach <= width:
        shingles = np.minimum(shingles[:-reach], shingles[reach:])
        reach *= 2
    return np.minimum(shingles[: len(shingles) - (width - reach)], shingles[width - reach :])


def _permuted(shingles: np.ndarray, k: int) -> np.ndarray:
    return mix(shingles ^ mix(np.array([k + 1], dtype=np.uint64)))


def templates(texts: tuple[tuple[str, str], ...] = TEMPLATES) -> list[Template]:
    """Templates of one shingle or more; shorter ones retrieve nothing."""
    found = []
    for name, text in texts:
        data, at = text_buffer(pa.array([text]))
        starts, ends, _ = word_bounds(data, at, _MARK)
        runs = shingle_hashes(word_hashes(data, starts, ends), SHINGLE)
        if len(runs):
            signature = np.array([_permuted(runs, k).min() for k in range(BANDS * ROWS)])
            found.append(Template(name, np.unique(runs), signature, len(runs)))
    return found


def _may_hold(runs: np.ndarray, first: np.ndarray, last: np.ndarray, known: list[Template], contained: float) -> list[np.ndarray]:
    """Per template, the rows that hold enough of its shingles anywhere; no other row has a match."""
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t.shingles for t in known)]))
    if not len(every):
        return []
    at = np.minimum(np.searchsorted(every, runs), len(every) - 1)
    places = np.flatnonzero(every[at] == runs)
    row = np.searchsorted(first, places, side="right") - 1
    # texts are read one after another; a shingle may not reach into the next text
    inside = places < last[row]
    row, shingle = np.divmod(np.unique(row[inside] * len(every) + at[places[inside]]), len(every))
    found = []
    for t in known:
        held = np.bincount(row[np.isin(every, t.shingles)[shingle]], minlength=len(last))
        found.append(np.flatnonzero((held / len(t.shingles) >= contained) & (last > first[:-1])))
    return found


def scan(column: pa.Array, known: list[Template], contained: float = CONTAINED) -> list[tuple[int, str, int, float]]:
    """(row, license, first word, containment) of each row's best window per license."""
    data, offsets = text_buffer(column)
    best: dict[tuple[int, str], tuple[float, int]] = {}
    for a, b in slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_bounds(part, at, _MARK)
        runs = shingle_hashes(word_hashes(part, starts, ends), SHINGLE)
        last = np.maximum(first[1:] - SHINGLE + 1, first[:-1])
        rows: dict[int, list[Template]] = {}
        for t, some in zip(known, _may_hold(runs, first, last, known, contained), strict=False):
            for r in some:
                rows.setdefault(int(r), []).append(t)
        for r, some in rows.items():
            own = runs[first[r] : last[r]]
            values = [_permuted(own, k) for k in range(BANDS * ROWS)]
            for t in some:
                # a text shorter than the template is one window
                places = np.zeros(1, np.int64)
                if len(own) >= t.width:
                    same = np.stack([_minima(v, t.width) == m for v, m in zip(values, t.signature, strict=True)])
                    places = np.flatnonzero(same.reshape(BANDS, ROWS, -1).all(axis=1).any(axis=0))
                for p in places:
                    share = float(np.isin(t.shingles, own[p : p + t.width]).mean())
                    key = (a + r, t.name)
                    if share >= contained and share > best.get(key, (0.0, 0))[0]:
                        best[key] = (share, int(p))
    return [(row, name, at, share) for (row, name), (share, at) in sorted(best.items())]


def license_scan(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, at_word, containment): a row per license found in a row of `docs`.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. at_word
    is the first word of the first window with the largest containment. Rows that repeat
    are scanned each time; null and empty texts have none; the templates (a parameter, on
    the driver) go to the executors; other columns are ignored.
    """
    known = templates(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = scan(batch.column("text"), known, contained)
            columns = [batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string())]
            columns += [pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "license", "at_word", "containment"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, at_word long, containment double")
