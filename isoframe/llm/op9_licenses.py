"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of t shingles falls in the class of the least power of two n >= t. Windows of 2n shingles begin every n, so
every occurrence lies inside one, whatever the text around it. BANDS one-row bands make the retrieval near certain: with
a share c >= 0.8 of the template in the window the likeness is at least ct / (2n + (1 - c)t), above 0.22 in the worst
case, and some band of 32 agrees with a probability above 0.9996. Window minima of one class are the pairwise minima of
the class below. A batch of documents is one array, so the scan is a few array passes for each band; each document begins
on a boundary of the longest class and no window reaches past its end, so what is found depends on its text alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm.common import map_arrow, read_table
from isoframe.llm.op7_sketches import SHINGLE_WORDS, hash_words

BANDS = 32
CONTAINMENT = 0.8
LAST = np.uint64((1 << 64) - 1)

# Notices of common public licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 wording": "Licensed under the Apache License 2.0",
    "Apache-2.0 identifier": "SPDX-License-Identifier: Apache-2.0",
    "MIT line": "Released under the MIT License.",
    "MIT wording": "licensed under the MIT License",
    "MIT wording 2": "available under the MIT License",
    "MIT wording 3": "distributed under the MIT License",
    "MIT notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD-2-Clause notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause notice": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 wording": "licensed under the GNU General Public License v3.0",
    "LGPL notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 line": "licensed under the GNU Lesser General Public License, version 3.",
    "AGPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0 line": "licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: A notice that comes with another one, which is not reported within NEAR words of it.
NEAR = 64
PART_OF = {"BSD-3-Clause notice": "BSD-2-Clause notice"}
#: Notices so alike that one nearly contains the other: at one place, the one that matches what the other matches and more.
ALIKE = [("AGPL notice", "GPL notice", "LGPL notice")]

#: ASCII letters and digits in lower case and all bytes beyond ASCII are word characters, others separate words.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
_SEEDS = [(int(a), int(b) | 1) for a, b in np.random.Generator(np.random.PCG64(9)).integers(0, 1 << 64, (BANDS, 2), np.uint64)]


def fold(text: str | None) -> list[bytes]:
    """The words that are compared: case and punctuation do not count."""
    return (text or "").encode().translate(_FOLD).split()


def band_hash(h: np.ndarray, band: int) -> np.ndarray:
    """One of BANDS independent orders of the shingles."""
    a, b = _SEEDS[band]
    x = (h ^ np.uint64(a)) * np.uint64(b)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """Band values of the templates, by class of length."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = sorted(templates)
        self.number = {name: i for i, name in enumerate(self.names)}
        self.shingles: list[np.ndarray] = []
        self.classes: dict[int, list[int]] = {}
        for i, name in enumerate(self.names):
            words = fold(templates[name])
            if len(words) < SHINGLE_WORDS:
                raise ValueError(f"template {name!r} has fewer than {SHINGLE_WORDS} words")
            self.shingles.append(np.unique(hash_words(words)))
            # Windows count shingles with their repeats.
            self.classes.setdefault(1 << (len(words) - SHINGLE_WORDS).bit_length(), []).append(i)
        self.bands: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n, members in self.classes.items():
            for band in range(BANDS):
                values = np.array([band_hash(self.shingles[i], band).min() for i in members], np.uint64)
                table = np.zeros(1 << 16, bool)
                table[(values >> np.uint64(48)).astype(np.int64)] = True
                self.bands.setdefault(n, []).append((values, table))


@lru_cache(maxsize=4)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


@dataclass(frozen=True)
class Hit:
    """A window that contains a template: its shingles [first, last), the template's share in it, the places matched."""

    first: int
    last: int
    share: float
    at: np.ndarray


def hits(index: Index, texts: list[str | None]) -> tuple[list[np.ndarray], list[dict[int, list[Hit]]]]:
    """For each text its shingles, and the verified windows of each template in it."""
    found: list[dict[int, list[Hit]]] = [{} for _ in texts]
    hashes = [hash_words(w) if len(w) >= SHINGLE_WORDS else np.zeros(0, np.uint64) for w in map(fold, texts)]
    longest = max(index.classes)
    ends = np.cumsum([-(-len(h) // longest) * longest for h in hashes])
    if not len(ends) or not ends[-1]:
        return hashes, found
    starts = np.concatenate(([0], ends[:-1]))
    stream, blank = np.zeros(ends[-1], np.uint64), np.ones(ends[-1], bool)
    for h, s in zip(hashes, starts.tolist(), strict=True):
        stream[s : s + len(h)] = h
        blank[s : s + len(h)] = False
    maybe: dict[int, dict[int, set[int]]] = {n: {} for n in index.classes}
    for band in range(BANDS):
        low, n = band_hash(stream, band), 1
        low[blank] = LAST
        while n <= longest:
            if n in index.classes:
                after = np.append(low[1:], LAST)
                after[ends // n - 1] = LAST
                window = np.minimum(low, after)
                values, table = index.bands[n][band]
                for w in np.nonzero(table[(window >> np.uint64(48)).astype(np.int64)])[0].tolist():
                    for member in np.nonzero(values == window[w])[0].tolist():
                        maybe[n].setdefault(w, set()).add(index.classes[n][member])
            if n < longest:
                low = np.minimum(low[0::2], low[1::2])
            n *= 2
    for n, windows in maybe.items():
        for w, members in windows.items():
            d = int(np.searchsorted(ends, w * n, "right"))
            first = w * n - int(starts[d])
            part = hashes[d][first : first + 2 * n]
            for i in members:
                share = float(np.isin(index.shingles[i], part).mean())
                if share >= CONTAINMENT:
                    found[d].setdefault(i, []).append(Hit(first, first + len(part), share, first + np.nonzero(np.isin(part, index.shingles[i]))[0]))
    return hashes, found


def _accounted(index: Index, i: int, x: Hit, found: dict[int, list[Hit]], h: np.ndarray) -> bool:
    """Whether another template explains this window of template i, at the same place."""
    name = index.names[i]
    of = lambda other: index.number.get(other, -1)
    for whole, part in PART_OF.items():
        if name == part and any(max(x.at[0] - y.at[-1], y.at[0] - x.at[-1]) <= NEAR for y in found.get(of(whole), ())):
            return True
    for other in (o for group in ALIKE if name in group for o in group if o != name):
        if any(y.first < x.last and x.first < y.last for y in found.get(of(other), ())):
            theirs = np.isin(h[x.first : x.last], index.shingles[of(other)])
            if theirs[x.at - x.first].all() and theirs.sum() > len(x.at):
                return True
    return False


def scan(index: Index, texts: list[str | None]) -> list[dict[int, float]]:
    """For each text the templates it contains, with the share of their shingles in the best window; a window that another
    template accounts for does not count, wherever else in the text that one is."""
    out = []
    for h, found in zip(*hits(index, texts), strict=True):
        left = {i: [x.share for x in windows if not _accounted(index, i, x, found, h)] for i, windows in found.items()}
        out.append({i: max(shares) for i, shares in left.items() if shares})
    return out


def scan_documents(docs: DataFrame, templates: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_licenses, licenses (names in order, joined by "; "), containment (the largest).

    Texts of any length are scanned whole. Where notices that are alike match one place equally well, all are reported. Null and empty texts and texts of fewer than five words contain none; containment is 0 then. Repeated rows and a null
    doc_id keep their rows. Other columns of docs are neither read nor returned. An empty table gives no rows.
    """
    chosen = tuple(sorted((TEMPLATES if templates is None else templates).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(chosen)
        for batch in batches:
            found = scan(index, batch.column(1).to_pylist())
            cols = (
                pa.array([len(f) for f in found], pa.int32()),
                pa.array(["; ".join(index.names[i] for i in sorted(f)) for f in found], pa.string()),
                pa.array([max(f.values(), default=0.0) for f in found], pa.float64()),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_licenses", "licenses", "containment"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, "doc_id long, n_licenses int, licenses string, containment double")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, scanned for the fixed templates."""
    return scan_documents(read_table(spark, sf_dir, "documents"))
