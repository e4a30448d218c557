"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of n two-word shingles is cut into segments of s, the largest power of two up to CONTAINMENT of n and to LARGEST;
every run of s shingles of a text is a window of that class. A text that holds a share c of a template holds at least
1 - (1 - c) * n / (s * floor(n / s)) of some segment in one window, whose Jaccard similarity with the segment follows, and
`bands_for` takes as many bands of ROWS min-hashes as make such a pair meet with the wanted probability. Before that, windows
with fewer of a class's shingles than such a share are left out, which loses nothing. Band keys of all templates are looked up
together, so the cost of a text hardly follows the number of templates. The containment of each template retrieved for a text
is then counted exactly for all runs of n shingles of the text, or for the whole of a shorter text. Of those of one template
that overlap, the one that holds most stays, the first of equals.

TEMPLATES holds short notices, standard headers and some whole texts; others are passed as a parameter. Defined results: words
as in `common`; spans count code points, end exclusive, from the first word of the window to its last, and go by place and
then by template; a text of any length is read whole; null and empty texts have none; repeated rows each give a row; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metrelle.llm.common import grams, mix, seeds, small_batches, text_slices, word_hashes

#: Notices by license; fixed values.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-3-clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
SHINGLE, ROWS = 2, 1
CONTAINMENT, PROBABILITY = 0.8, 0.9995
#: Shingles of a segment at most; bits of the table by which shingles of no template are told apart.
LARGEST, TABLE_BITS = 64, 20


def bands_for(containment: float = CONTAINMENT, rows: int = ROWS, probability: float = PROBABILITY) -> int:
    """The bands with which a window that holds that share of a segment of its size meets it with that probability."""
    alike = (containment / (2 - containment)) ** rows
    return max(1, math.ceil(math.log(1 - probability) / math.log(1 - alike))) if alike < 1 else 1


def _hashed(shingles: np.ndarray, k: int) -> np.ndarray:
    return mix(shingles ^ seeds(k + 1, 5)[k])


def _sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every run of n values, n a power of two, by doubling."""
    size, now = 1, values
    while size < n:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    return now


class Scanner:
    """Templates prepared for a scan."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT):
        self.containment, self.templates = containment, []
        for name, text in sorted(templates.items()):
            data = np.frombuffer(text.encode(), np.uint8)
            words, _, _, first = word_hashes(data, np.array([0, len(data)]))
            found, _, _ = grams(words, first, SHINGLE)
            if len(words) >= SHINGLE:
                self.templates.append((name, found, np.unique(found)))
        sizes = [min(LARGEST, 1 << int(math.log2(max(1, containment * len(found) + 1e-9)))) for _, found, _ in self.templates]
        self.held = np.zeros(1 << TABLE_BITS, np.uint8)
        self.classes = []
        for c, size in enumerate(sorted(set(sizes))):
            own = [t for t, s in enumerate(sizes) if s == size]
            least = min(1 - (1 - containment) * (n := len(self.templates[t][1])) / (size * (n // size)) for t in own)
            bands, keys, owners = bands_for(max(least, 0.05)), [], []
            for t in own:
                found = self.templates[t][1]
                self.held[found >> np.uint64(64 - TABLE_BITS)] |= 1 << c
                for at in sorted({*range(0, len(found) - size + 1, size), len(found) - size}):
                    keys += [self._key([_hashed(found[at : at + size], b * ROWS + r).min() for r in range(ROWS)], b) for b in range(bands)]
                    owners += [t] * bands
            order = np.argsort(keys, kind="stable")
            self.classes.append((size, max(1, math.ceil(least * size - 1e-9)), bands, np.array(keys, np.uint64)[order], np.array(owners)[order]))

    @staticmethod
    def _key(mins, band: int):
        """A band's key, of numbers or arrays."""
        key = np.uint64(band + 1)
        for m in mins:
            key = mix(np.bitwise_xor(np.asarray(m, np.uint64), key))
        return key

    def rows(self, shingles: np.ndarray, runs: np.ndarray) -> list[int]:
        """The texts in which some window is dense enough to be looked up; runs: where each text's shingles begin."""
        held = self.held[shingles >> np.uint64(64 - TABLE_BITS)]
        if not held.any():
            return []
        return sorted({int(i) for c in range(len(self.classes)) for i in np.searchsorted(runs, self._dense(held, c), "right") - 1})

    def _dense(self, held: np.ndarray, c: int) -> np.ndarray:
        size, least = self.classes[c][:2]
        total = np.concatenate([[0], np.cumsum(held >> c & 1, dtype=np.int64)])
        return np.flatnonzero(total[size:] - total[:-size] >= least) if len(held) >= size else np.zeros(0, int)

    def retrieved(self, shingles: np.ndarray) -> set[int]:
        """The templates that share a band key with a window of one text."""
        held, found = self.held[shingles >> np.uint64(64 - TABLE_BITS)], set()
        hashed: dict[int, np.ndarray] = {}
        for c, (size, _, bands, keys, owners) in enumerate(self.classes):
            at = self._dense(held, c)
            if not len(at):
                continue
            for b in range(bands):
                mins = []
                for r in range(b * ROWS, (b + 1) * ROWS):
                    if r not in hashed:
                        hashed[r] = _hashed(shingles, r)
                    mins.append(_sliding_min(hashed[r], size)[at])
                key = np.unique(self._key(mins, b))
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                for x, y in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    found.update(owners[x:y].tolist())
        return found

    def shares(self, shingles: np.ndarray, t: int) -> tuple[int, np.ndarray]:
        """The length of a window of one text for template t, and of every such window the share of the template that it holds."""
        _, found, own = self.templates[t]
        n = min(len(found), len(shingles))
        windows = len(shingles) - n + 1
        place = np.flatnonzero(np.isin(shingles, own))
        kind = shingles[place]
        order = np.lexsort((place, kind))
        before = np.full(len(place), -1)
        same = kind[order][1:] == kind[order][:-1]
        before[order[1:][same]] = place[order[:-1][same]]
        # A place counts for the windows that hold it and not its shingle's place before.
        change = np.zeros(windows + 1, np.int64)
        start, end = np.maximum(np.maximum(before + 1, place - n + 1), 0), np.minimum(place + 1, windows)
        np.add.at(change, np.minimum(start, end), 1)
        np.add.at(change, end, -1)
        return n, np.cumsum(change[:-1]) / len(own)

    def scan(self, shingles: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(first shingle, end, template, containment) of the windows of one text that hold a template."""
        out = []
        for t in sorted(self.retrieved(shingles)):
            n, share = self.shares(shingles, t)
            best: list[tuple[int, int, int, float]] = []
            for at in np.flatnonzero(share >= self.containment - 1e-9).tolist():
                if best and at < best[-1][1]:
                    if share[at] > best[-1][3]:
                        best[-1] = (at, at + n, t, float(share[at]))
                else:
                    best.append((at, at + n, t, float(share[at])))
            out += best
        return sorted(out)


def scanned(documents: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, found): for every row the licenses found, array<struct<license, start, end, containment>> by place."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Scanner(templates or TEMPLATES, containment))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))
        for batch in batches:
            out: list[list[dict]] = []
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words, starts, ends, first = word_hashes(data, offsets)
                shingles, at, runs = grams(words, first, SHINGLE)
                part: list[list[dict]] = [[] for _ in range(hi - lo)]
                for i in scanner.rows(shingles, runs):
                    begin = int(runs[i])
                    if first[i + 1] - first[i] < SHINGLE:
                        continue
                    found = scanner.scan(shingles[begin : runs[i + 1]])
                    if not found:
                        continue
                    chars = np.concatenate([[0], np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)])
                    for s, e, t, share in found:
                        left, right = starts[at[begin + s]] - offsets[i], ends[at[begin + e - 1] + SHINGLE - 1] - offsets[i]
                        part[i].append({"license": scanner.templates[t][0], "start": int(chars[left]), "end": int(chars[right]), "containment": share})
                out += part
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "found"])

    doc = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {doc}, found array<struct<license:string,start:int,end:int,containment:double>>")


def digest(documents: DataFrame) -> DataFrame:
    """The rows of query op5_licenses."""
    return scanned(documents).selectExpr(
        "doc_id", "size(found) AS n_notices", "array_join(array_sort(array_distinct(found.license)), ',') AS licenses",
        "array_join(transform(found, x -> concat_ws(':', x.license, string(x.start), string(x.end))), ',') AS spans",
    )
