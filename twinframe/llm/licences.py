"""Licence scans: Dice coefficient of word-bigram sets between licence templates and passages of a text.

Texts are normalised: letters and digits only, lower-cased, one spelling of "licence". A passage is the whole text or a run of words, of
each of a few lengths about a template's own; a run may start at any word, so a licence is found inside a longer text, over several
paragraphs or within a line. With t the threshold, a template of b bigrams can only match passages that share t / (2 - t) b of them; an
inverted index from bigrams to templates counts the distinct ones that the whole text shares, and prunes the templates with fewer. For
those that remain, the coefficient of every run is exact: a run's distinct bigrams are those whose last occurrence lies before it, and
sums of such differences give all runs at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import documents, prepare

THRESHOLD = 0.8
#: Lengths of runs, as multiples of a template's words. Between two of them, a passage loses 8 % of its words at most.
LENGTHS = (0.7, 0.84, 1.0, 1.18, 1.4)
#: Full texts of longer licences, one file each, named after the licence.
TEXTS = Path(__file__).parent / "licence_texts"

#: Wording of public licences and of the usual notices that name one.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>""",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0 notice": "Licensed under the Mozilla Public License, version 2.0.",
    "BSD notice": "Released under the BSD License.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0 notice": "Released into the public domain under CC0 1.0.",
}


def lowered(text: str) -> str:
    """Lower-cased, each character as one, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", lowered(text).replace("licence", "license"))


def bigrams(found: list[str]) -> set[tuple[str, str]]:
    return set(zip(found, found[1:]))


def templates_in(folder: str | Path = TEXTS) -> dict[str, str]:
    """The texts of a folder's .txt files by name."""
    return {p.stem: p.read_text() for p in sorted(Path(folder).glob("*.txt"))}


def distinct_in_runs(number: np.ndarray, size: int) -> np.ndarray:
    """For each start, how many different non-negative numbers the run of ``size`` from there has."""
    n = len(number)
    order = np.argsort(number, kind="stable")
    before = np.full(n, -1)
    same = number[order][1:] == number[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    own = number >= 0
    at = np.flatnonzero(own)
    first = np.maximum(before[own] + 1, at - size + 1)  # a bigram counts for the runs that start after its last occurrence
    steps = np.bincount(first, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
    return np.cumsum(steps)[:n]


class Templates:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold = threshold
        split = {n: words(t) for n, t in templates.items()}
        self.names = [n for n, w in split.items() if len(w) > 1]
        sets = [bigrams(split[n]) for n in self.names]
        self.sizes = [len(b) for b in sets]
        self.lengths = [len(split[n]) for n in self.names]
        self.needed = [math.ceil(threshold / (2 - threshold) * b - 1e-9) for b in self.sizes]
        self.inverted: dict[tuple[str, str], list[int]] = {}
        for k, b in enumerate(sets):
            for gram in b:
                self.inverted.setdefault(gram, []).append(k)

    def match(self, found: list[str]) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, first word, end word): the passages of at least the threshold that overlap no better one of the same text."""
        pairs = list(zip(found, found[1:]))
        shared = Counter(k for g in set(pairs).intersection(self.inverted) for k in self.inverted[g])
        left = [k for k, c in shared.items() if c >= self.needed[k]]
        if not left:
            return []
        numbers: dict[tuple[str, str], int] = {}
        every = np.array([numbers.setdefault(g, len(numbers)) for g in pairs])
        offered = []
        for k in left:
            own = np.array([k in self.inverted.get(g, ()) for g in numbers])
            here = np.where(own[every], every, -1)
            whole = 2 * shared[k] / (len(numbers) + self.sizes[k])
            if whole >= self.threshold:
                offered.append((whole, 0, len(found), k))
            for size in sorted({max(1, min(len(pairs), round(f * self.lengths[k]) - 1)) for f in LENGTHS}):
                common = distinct_in_runs(here, size)
                good = np.flatnonzero((common >= self.needed[k]) & (here >= 0))
                if not len(good):
                    continue
                dice = 2 * common[good] / (distinct_in_runs(every, size)[good] + self.sizes[k])
                keep = dice >= self.threshold
                offered += [(d, s, min(s + size, len(pairs)) + 1, k) for d, s in zip(dice[keep].tolist(), good[keep].tolist())]
        chosen: list[tuple[float, int, int, int]] = []
        taken = np.full(len(found), -1)  # index of the passage that has a word
        for d, a, b, k in sorted(set(offered), key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
            over = np.unique(taken[a:b])
            if not (over >= 0).any():
                taken[a:b] = len(chosen)
            elif not all(o >= 0 and chosen[o][:3] == (d, a, b) for o in over.tolist()):
                continue
            chosen.append((d, a, b, k))
        return [(self.names[k], d, a, b) for d, a, b, k in chosen]


def licences(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, dice, start, end, n_parts: for each document and template with a match, the best passage and how many match.

    Passages overlap no better one, be it of another template; equally good templates of the same passage are all given. Of equally good
    passages the first is given. start and end are code points. Null and empty texts match nothing; repeated rows and null doc_ids are
    scanned each for itself. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES | templates_in(), threshold))  # as large as the templates
    schema = pa.schema([("doc_id", pa.int64()), ("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("n_parts", pa.int64())])

    def scan(batches):
        index = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                hits = index.match(words(text)) if text else []
                places = [m.span() for m in re.finditer(r"[^\W_]+", lowered(text))] if hits else []
                best: dict[str, list] = {}
                for name, dice, a, b in hits:
                    own = best.setdefault(name, [(-1.0, 0, 0), 0])
                    own[0] = max(own[0], (dice, -places[a][0], places[b - 1][1]))
                    own[1] += 1
                rows += [(doc, name, round(d, 6), -s, e, n) for name, ((d, s, e), n) in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, licence string, dice double, start long, end long, n_parts long")


def op9_licence_scans(spark, sf_dir):
    return licences(documents(spark, sf_dir))
