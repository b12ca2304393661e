"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Templates and texts are compared as five-word shingles of lower-cased words of letters and digits. For every
template length class (its number of shingles, rounded up to a power of two) each text is cut into windows of
twice that many shingles that overlap by at least the class size, so any place where a template stands lies wholly
in one window. Windows and templates get MinHash signatures; bands of one slot each retrieve templates for a
window. A window that holds 80% of a template's shingles has a Jaccard similarity with it of at least
0.8 * n / (2 * size + 0.2 * n) > 0.18 for n > size / 2, so 64 one-slot bands miss with probability below 4e-6.
Retrieved templates are verified: the share of their distinct shingles in the window must reach 0.8. Windows
without a single shingle of any template cannot pass and are not signed.

Nulls and edge cases: null and empty texts match nothing; templates with fewer than five words are one shingle of
all their words and match texts of exactly these words; a template reports its best window per document (highest
containment, then first); rows with equal doc_ids each give their own rows; an empty table gives no rows; other
columns are ignored. Templates are a bounded parameter: at most `MOST_TEMPLATES`, or the scan refuses.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scholarsieve.llm.common import GOLDEN, PLAIN, byte_blocks, hashed_words, mix

WIDTH = 5
BANDS = 64
CONTAINMENT = 0.8
MOST_TEMPLATES = 10_000

# Public license notices, bodies without the copyright line, and usual single lines.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                         'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
                         "See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause-line": "Licensed under the BSD 3-Clause License.",
    "BSD-source-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-line": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                      "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
                      "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MIT-line": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
                      "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                      "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                      "You can obtain one at https://mozilla.org/MPL/2.0/.",
}
_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
          "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
          "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. ")
_BSD_AS_IS = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
              "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
              "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
              "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
              "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gpl(thing: str, kind: str, version: str) -> str:
    return (f"{thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software "
            f"Foundation; either version {version} of the License, or (at your option) any later version. {thing} is distributed in the hope that it will be useful, but "
            "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
            f"See the GNU {kind} General Public License for more details.")


TEMPLATES |= {
    "MIT-body": TEMPLATES["MIT-permission"] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    "BSD-2-Clause-body": _BSD + _BSD_AS_IS,
    "BSD-3-Clause-body": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                                "software without specific prior written permission. " + _BSD_AS_IS,
    "ISC-body": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
                'notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
                "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
                "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
                "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense-body": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
                      "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-body": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
                 "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
                 "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
                 "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
                 "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
                 "source distribution.",
    "BSL-1.0-body": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
                    'license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to '
                    "permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "EPL-1.0-notice": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies "
                      "this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
                      "https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-notice": _gpl("This program", "", "2"),
    "LGPL-2.1-notice": _gpl("This library", "Lesser", "2.1"),
    "LGPL-3.0-notice": _gpl("This program", "Lesser", "3"),
    "AGPL-3.0-notice": _gpl("This program", "Affero", "3"),
}
# Usual wordings of single lines, of at least five words.
_LINES = {
    "MIT": "MIT license", "Apache-2.0": "Apache License 2.0", "BSD-2-Clause": "BSD 2-Clause license", "BSD-3-Clause": "BSD 3-Clause license", "ISC": "ISC license",
    "GPL-2.0": "GNU General Public License v2.0", "GPL-3.0": "GNU General Public License v3.0", "LGPL": "GNU Lesser General Public License",
    "AGPL-3.0": "GNU Affero General Public License v3.0", "MPL-2.0": "Mozilla Public License 2.0", "EPL-2.0": "Eclipse Public License 2.0", "BSL-1.0": "Boost Software License",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International", "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International",
}
_LEADS = {"licensed": "is licensed under the", "terms": "under the terms of the", "available": "available under the"}
TEMPLATES |= {f"{name}-{key}-line": f"{lead} {text}" for name, text in _LINES.items() for key, lead in _LEADS.items()}


def shingles(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place) of every shingle in text order; a text of fewer words has one of all its words."""
    counts = np.bincount(rows) if len(rows) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    last = np.maximum(counts - WIDTH + 1, (counts > 0).astype(counts.dtype))
    row = np.repeat(np.arange(len(counts)), last)
    place = np.arange(len(row)) - np.repeat(np.cumsum(last) - last, last)
    at = starts[row] + place
    value = words[at] if len(at) else np.zeros(0, np.uint64)
    for k in range(1, WIDTH):
        inside = place + k < counts[row] if len(row) else np.zeros(0, bool)
        value = np.where(inside, mix(value * GOLDEN + words[np.minimum(at + k, len(words) - 1)]), value) if len(at) else value
    return value, row, place


class Library:
    """Templates by length class: sorted shingles, signatures and band tables."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} license templates")
        self.bands = bands
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)
        self.names, self.sets = list(templates), []
        for text in templates.values():
            data = np.frombuffer(text.encode(), np.uint8)
            value, _, _ = shingles(*hashed_words(data, np.array([0, len(data)]), PLAIN))
            self.sets.append(np.unique(value))
        self.classes: dict[int, list[dict[int, list[int]]]] = {}
        for i, values in enumerate(self.sets):
            if len(values):
                size = 1 << int(len(values) - 1).bit_length()
                tables = self.classes.setdefault(size, [{} for _ in range(bands)])
                for table, key in zip(tables, self.signature(values[None, :])[0]):
                    table.setdefault(int(key), []).append(i)
        self.known = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))

    def signature(self, windows: np.ndarray) -> np.ndarray:
        """(windows, bands) minima of salted shingle hashes."""
        return np.stack([mix(windows ^ s).min(axis=1) for s in self.salt], axis=1)

    def scan(self, values: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first shingle, shingles, containment): the best window of each template in one text."""
        best: dict[int, tuple[float, int, int]] = {}
        hit = np.isin(values, self.known)
        if not hit.any():
            return []
        before = np.concatenate([[0], np.cumsum(hit)])
        for size, tables in self.classes.items():
            starts = np.arange(0, max(1, len(values) - size), size)
            ends = np.minimum(starts + 2 * size, len(values))
            for a, b in zip(starts, ends):
                if before[b] == before[a]:
                    continue
                window = values[a:b]
                keys = self.signature(window[None, :])[0]
                for i in {i for table, key in zip(tables, keys) for i in table.get(int(key), ())}:
                    share = float(np.isin(self.sets[i], window).mean())
                    if share >= CONTAINMENT:
                        inside = a + np.flatnonzero(np.isin(window, self.sets[i]))
                        found = (share, int(inside[0]), int(inside[-1] - inside[0] + 1))
                        if i not in best or (found[0], -found[1]) > (best[i][0], -best[i][1]):
                            best[i] = found
        return [(i, at, n, share) for i, (share, at, n) in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, first_word, n_words, containment) of every template found in a document."""
    templates = TEMPLATES if templates is None else templates

    def find(batches):
        library = Library(templates)
        for batch in batches:
            docs_, names, at, size, share = [], [], [], [], []
            ids = batch.column(0).to_pylist()
            for first, data, offsets in byte_blocks(batch.column(1)):
                values, row, _ = shingles(*hashed_words(data, offsets, PLAIN))
                bounds = np.searchsorted(row, np.arange(len(offsets)))
                for r in np.unique(row[np.isin(values, library.known)]):
                    for i, place, n, contained in library.scan(values[bounds[r]:bounds[r + 1]]):
                        docs_.append(ids[first + r])
                        names.append(library.names[i])
                        at.append(place)
                        size.append(n + WIDTH - 1)
                        share.append(contained)
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(names, pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64()),
                                              pa.array(share, pa.float64())], names=["doc_id", "license", "first_word", "n_words", "containment"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, license string, first_word long, n_words long, containment double")
