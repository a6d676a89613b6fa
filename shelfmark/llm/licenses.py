"""License notices in documents, by MinHash bands over windows, verified exactly.

Templates and documents are cut into five-word shingles.  A template of m shingles
belongs to the scale w, the largest power of two that m reaches; a document gets a window
of w shingles every w/4 from its first shingle on (every shingle where w is under 4), one
that ends at its last, and one of all its shingles if these are fewer; templates get one
at every place.
A window is sketched by BANDS minima, each a band of one row.  An untouched notice lies at
most w/8 off some window of its own scale, so the two share a Jaccard similarity of 7/9 at
least and meet in a band with a probability over 1 - (2/9)**8, that is 0.999994; a window
of one shingle always meets its equal.  What meets is verified by the exact part of the
template's shingles that stand together in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X

SHINGLE, BANDS, CONTAINMENT = 5, 8, 0.8

# Public notices and license texts, whole or their characteristic passages.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT notice, licensed": "Licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(X.ALNUM_LOWER).split()


def minima(h: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A row for each band of independent 32-bit values of the shingles."""
    seeds = X.mix(np.arange(1, bands + 1, dtype=np.uint64))
    return np.stack([(X.mix(h ^ s) >> np.uint64(32)).astype(np.uint32) for s in seeds])


class Templates:
    """Templates by scale, with the band values of their windows."""

    def __init__(self, templates: dict[str, str], k: int = SHINGLE):
        self.names = list(templates)
        self.words = [words_of(templates[n].encode()) for n in self.names]
        self.shingles = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in self.words]
        self.scales: dict[int, dict] = {}
        for t, w in enumerate(self.words):
            _, _, h, counts = X.hashed_words([b" ".join(w)], X.ALNUM_LOWER)
            sh, _ = X.shingles(h, counts, k)
            if not len(sh):
                continue
            size = 1 << (len(sh).bit_length() - 1)
            values, bands = minima(sh), BANDS if size > 1 else 1
            at = self.scales.setdefault(size, {"bands": [{} for _ in range(bands)], "filter": np.zeros((bands, 1 << 16), bool)})
            for i in range(len(sh) - size + 1):
                for b in range(bands):
                    v = int(values[b, i : i + size].min())
                    at["bands"][b].setdefault(v, set()).add(t)
                    at["filter"][b, v & 0xFFFF] = True

    def meetings(self, texts: list[bytes | None], k: int = SHINGLE) -> set[tuple[int, int, int]]:
        """(text, first word, template) of windows that share a band with a template."""
        _, _, h, counts = X.hashed_words(texts, X.ALNUM_LOWER)
        sh, at = X.shingles(h, counts, k)
        if not len(sh):
            return set()
        owner = np.repeat(np.arange(len(texts)), counts)
        first = (np.cumsum(counts) - counts)[owner]
        edge = np.flatnonzero(np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]]))
        has = np.diff(np.append(edge, len(sh)))
        rank, left = np.arange(len(sh)) - np.repeat(edge, has), np.repeat(edge + has, has) - np.arange(len(sh))
        out: set[tuple[int, int, int]] = set()

        def meet(scale: dict, place: np.ndarray, mine: np.ndarray) -> None:
            for b, values in enumerate(scale["bands"]):
                for i in np.flatnonzero(scale["filter"][b][mine[b] & np.uint32(0xFFFF)]):
                    for t in values.get(int(mine[b, i]), ()):
                        word = at[place[i]]
                        out.add((int(owner[word]), int(word - first[word]), t))

        now, size = minima(sh), 1
        whole = np.minimum.reduceat(now, edge, axis=1)
        for n, scale in self.scales.items():
            meet(scale, edge[has < n], whole[:, has < n])
        while True:
            if size in self.scales:
                stride = max(1, size // 4)
                place = np.flatnonzero(((rank % stride == 0) & (left >= size)) | (left == size))
                meet(self.scales[size], place, now[:, place])
            if 2 * size > max(self.scales, default=0) or now.shape[1] <= size:
                return out
            now = np.minimum(now[:, :-size], now[:, size:])
            size *= 2

    def verified(self, text: bytes, found: list[tuple[int, int]], containment: float, k: int = SHINGLE) -> list[tuple[int, int, int, float]]:
        """(template, start, end, containment) of places, in words, that hold up.  A place
        is taken up to twice around; meetings of one place give it once."""
        words, out = words_of(text), {}
        for at, t in found:
            m = len(self.words[t])
            low, high = max(0, at - m), min(len(words), at + 2 * m)
            hit = [i for i in range(low, high - k + 1) if tuple(words[i : i + k]) in self.shingles[t]]
            # The fullest stretch of a template's length and a quarter.
            best, span = 0, None
            for n, i in enumerate(hit):
                inside = [j for j in hit[n:] if j + k <= i + m + m // 4]
                got = len({tuple(words[j : j + k]) for j in inside})
                if got > best:
                    best, span = got, (i, inside[-1] + k)
            if span and best >= containment * len(self.shingles[t]):
                key = (t, *span)
                out[key] = max(out.get(key, 0.0), best / len(self.shingles[t]))
        return [(*key, c) for key, c in sorted(out.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, start, end, containment) of every notice in every row of docs.

    start and end count words: runs of ASCII letters, digits and other code points from
    0x80 on, lower-cased.  A template of fewer than five words is never found.  A null
    text has none; repeated rows are reported each; other columns are ignored; an empty
    table gives no rows.
    """
    X.bounded_batches(docs.sparkSession)
    given = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(given)
        for batch in batches:
            texts, rows = X.as_bytes(batch.column("text")), []
            for a, b in X.chunks(texts):
                by: dict[int, list[tuple[int, int]]] = {}
                for i, at, t in sorted(known.meetings(texts[a:b])):
                    by.setdefault(a + i, []).append((at, t))
                for i, found in by.items():
                    rows += [(i, *r) for r in known.verified(texts[i], found, containment)]
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([known.names[r[1]] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.float64())], names=["doc_id", "license", "start", "end", "containment"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(X.tidy(run), "doc_id long, license string, start long, end long, containment double")
