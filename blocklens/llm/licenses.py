"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

A template of T five-word shingles belongs to the class L, the power of two with L/2 < T <= L.
Texts are read in windows of 2 L shingles, a new one every L, so any stretch of L shingles
lies within one. A window with at least 80 % of a template's shingles has a similarity s of
0.8 T / (2 L + 0.2 T) or more with it, at least 0.19, and with one minhash to a band and b
bands it fails to retrieve the template with a chance of (1 - s)**b at most; b is chosen so
that this is below ``MISS``.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.words import mixed, slices, split_words, text_numbers

WIDTH = 5
PERCENT = 80
MISS = 1e-6
SIGNS = r"[.,;:()\"']"

#: Common license notices and the parts of short licenses, by SPDX id.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
    "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions",
    "MIT-warranty": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND "
    "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
    "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
    "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
    "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}


def normal_words(texts: pa.Array):
    """Words without ``SIGNS``, A-Z lower-cased; words of signs only vanish."""
    return split_words(pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), SIGNS, ""))


def shingle_class(count: int) -> int:
    return 1 << (count - 1).bit_length()


def bands(count: int, percent: int = PERCENT) -> int:
    """Bands that retrieve a template of ``count`` shingles from any window with ``percent`` of them but for a chance of ``MISS``."""
    need = -(-count * percent // 100)
    similarity = need / (2 * shingle_class(count) + count - need)
    return math.ceil(math.log(MISS) / math.log(1 - similarity)) if similarity < 1 else 1


class Index:
    """Templates by class, with their minhash for each band and their exact shingles."""

    def __init__(self, templates: dict, percent: int = PERCENT):
        self.names, self.percent = sorted(templates), percent
        words = [normal_words(pa.array([templates[n]])) for n in self.names]
        self.lists = [[d[c].as_py() for c in codes] for codes, _, d in words]
        if short := [n for n, w in zip(self.names, self.lists) if len(w) < WIDTH]:
            raise ValueError(f"templates of fewer than {WIDTH} words: {short}")
        self.shingles = [{tuple(w[i : i + WIDTH]) for i in range(len(w) - WIDTH + 1)} for w in self.lists]
        keys = [shingle_hashes(pa.array([" ".join(w)]))[0] for w in self.lists]
        self.classes = {}
        for t, s in enumerate(self.shingles):
            self.classes.setdefault(shingle_class(len(s)), []).append(t)
        self.bands = {size: max(bands(len(self.shingles[t]), percent) for t in own) for size, own in self.classes.items()}
        self.values = {size: np.array([[order(keys[t], b).min() for t in own] for b in range(self.bands[size])]) for size, own in self.classes.items()}


def order(keys: np.ndarray, band: int) -> np.ndarray:
    """The band's random order of shingles."""
    with np.errstate(over="ignore"):
        return keys * np.uint64((0x9E3779B97F4A7C15 * (2 * band + 1)) % 2**64 | 1) ^ np.uint64(0x2545F4914F6CDD1D * (band + 1) % 2**64)


def shingle_hashes(texts: pa.Array):
    """Hashes of all five-word shingles, their text, the place of their first word in all words, and the words."""
    import pandas as pd

    codes, starts, distinct = normal_words(texts)
    word = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    doc = text_numbers(starts)
    at = np.flatnonzero(doc[WIDTH - 1 :] == doc[: len(doc) - WIDTH + 1]) if len(codes) >= WIDTH else np.zeros(0, np.int64)
    key = np.zeros(len(at), np.uint64)
    for k in range(WIDTH):
        key = mixed(key ^ word[at + k], k)
    return key, doc[at], at, (codes, starts, distinct)


def candidates(index: Index, size: int, key, doc):
    """(window start among all shingles, template) of every window with a band equal to a template's."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    heads = np.flatnonzero(place % size == 0)  # a block of ``size`` shingles; a window is two blocks of a text
    joined = np.append(doc[heads[1:]] == doc[heads[:-1]], False)
    hit = set()
    for band, values in enumerate(index.values[size]):
        low = np.minimum.reduceat(order(key, band), heads)
        low = np.where(joined, np.minimum(low, np.append(low[1:], low[-1])), low)
        for t, value in zip(index.classes[size], values):
            hit.update((int(heads[w]), t) for w in np.flatnonzero(low == value))
    return hit


def scan(df: DataFrame, templates: dict = TEMPLATES, id_col="doc_id", text="text", percent: int = PERCENT) -> DataFrame:
    """One row per document and license found: id, license, matched, shingles, containment, first_word.

    A document has a license if a window holds at least ``percent`` of its template's
    distinct shingles; the window with most of them is reported, of equal ones the first, and
    first_word is the place of its first word. Null and short texts have none; rows with
    equal ids are scanned each for itself. Templates go to every task, so they are a bounded,
    given set; whole texts are read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    index = df.sparkSession.sparkContext.broadcast(Index(templates, percent))

    def run(batches):
        known = index.value
        for batch in batches:
            for part in slices(batch, "_text"):
                key, doc, at, (codes, starts, distinct) = shingle_hashes(part.column("_text"))
                if not len(key):
                    continue
                ends = np.searchsorted(doc, doc, side="right")
                best = {}
                for size in known.classes:
                    for head, t in sorted(candidates(known, size, key, doc)):
                        stop = min(head + 2 * size, ends[head])
                        words = [distinct[int(c)].as_py() for c in codes[at[head] : at[stop - 1] + WIDTH]]
                        found = len({tuple(words[i : i + WIDTH]) for i in range(stop - head)} & known.shingles[t])
                        row = int(doc[head])
                        if 100 * found >= known.percent * len(known.shingles[t]) and found > best.get((row, t), (0,))[0]:
                            best[row, t] = found, int(at[head] - starts[row])
                if best:
                    found = list(best.values())
                    rows = [list(x) for x in zip(*best)]
                    total = np.array([len(known.shingles[t]) for t in rows[1]])
                    matched = np.array([x for x, _ in found])
                    made = [part.column("_id").take(pa.array(rows[0])), pa.array([known.names[t] for t in rows[1]]), pa.array(matched), pa.array(total), pa.array(matched / total), pa.array([x for _, x in found])]
                    yield pa.RecordBatch.from_arrays(made, names=[id_col, "license", "matched", "shingles", "containment", "first_word"])

    ddl = f"{id_col} {kind}, license string, matched long, shingles long, containment double, first_word long"
    return df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, ddl)
