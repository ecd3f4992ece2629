"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .common import doc_bytes, map_batches, read
from .patience import align, longest

# Notices and texts in the words that their stewards prescribe.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_REST = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_REST = " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GNU = {"GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3")}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_SCOPE = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}

#: Notices and whole texts by SPDX id.
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License.", _GRANT, _GRANT + _MIT_REST],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE, _APACHE + _APACHE_REST],
    "BSD": ["Released under the BSD License.", _BSD_HEAD],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_TWO + _BSD_REST],
    "BSD-3-Clause": [_BSD_HEAD + _BSD_TWO + _BSD_THIRD + _BSD_REST],
    "ISC": [_ISC + ", provided that the above copyright notice and this permission notice appear in all copies.", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_REST],
    "0BSD": [_ISC + "." + _ISC_REST],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "All-rights-reserved": ["All rights reserved."],
}
TEMPLATES |= {
    name: [
        f"This work is licensed under the GNU {kind} Public License, version {version}.",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
    ]
    for name, (kind, version) in _GNU.items()
}
TEMPLATES |= {
    f"CC-{code}-{version}": [f"Licensed under CC {code} {version}.", f"This work is licensed under a Creative Commons {words} {version} {scope} License."]
    for code, words in _CC.items()
    for version, scope in _CC_SCOPE.items()
}


def read_templates(folder: str) -> dict[str, list[str]]:
    """One whole license text a file of a folder on the driver, by the file's name."""
    return {f.name.removesuffix(".txt"): [f.read_text(errors="replace")] for f in sorted(Path(folder).iterdir()) if f.is_file()}


_WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Common words that don't tell a license; all others of a template point to it.
_COMMON = set(b"a all and any are as at by for free from in is it may not of on or that the this to under use with work you".split())
MIN_COVERAGE = 0.8


def words_of(raw: bytes | None) -> list[bytes]:
    return _WORDS.findall((raw or b"").lower())


class Templates:
    def __init__(self, texts: dict[str, list[str]], min_coverage: float = MIN_COVERAGE):
        self.all = [(name, words_of(t.encode())) for name, ts in texts.items() for t in ts]
        self.all = [(name, words) for name, words in self.all if words]
        #: of each template the words that must match, and how many different cues then do at least
        self.needed = [-(-round(min_coverage * 10_000) * len(words) // 10_000) for _, words in self.all]
        self.least: list[int] = []
        self.cues: dict[bytes, set[int]] = {}
        for i, (_, words) in enumerate(self.all):
            cues = {w for w in words if w not in _COMMON and not w.isdigit()} or set(words)
            self.least.append(max(1, len(cues) - (len(words) - self.needed[i])))
            for w in cues:
                self.cues.setdefault(w, set()).add(i)

    def scan(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, word after the last) of each place that a
        template covers; of places that overlap the one with most matched words, then most coverage.

        A place is at most twice as long as its template, so it lies in one of the windows of
        three template lengths that begin at every one; those with too few different cue
        words (all but common ones) to reach the coverage are left out. The work is
        linear in the text for each template that it has cues of.
        """
        hits: dict[int, list[int]] = {}
        for at, w in enumerate(words):
            for i in self.cues.get(w, ()):
                hits.setdefault(i, []).append(at)
        found = []
        for i, places in hits.items():
            size = len(self.all[i][1])
            for k in sorted({max(0, p // size - d) for p in places for d in (0, 1, 2)}):
                a, b = k * size, min(len(words), (k + 3) * size)
                cues = {words[p] for p in places[bisect_left(places, a) : bisect_left(places, b)]}
                if len(cues) >= self.least[i]:
                    found += self._places(i, words, a, b)
        taken: list[tuple[int, int, str, float]] = []
        for _, name, coverage, a, b in sorted(found, key=lambda f: (-f[0], -f[2], f[1], f[3])):
            at = bisect_left(taken, (a,))
            if (at == len(taken) or taken[at][0] >= b) and (not at or taken[at - 1][1] <= a):
                insort(taken, (a, b, name, coverage))
        return [(name, coverage, a, b) for a, b, name, coverage in taken]

    def _places(self, i: int, words: list[bytes], a: int, b: int):
        """(matched words, license, coverage, first, after) of the places in words[a:b]."""
        (name, template), needed = self.all[i], self.needed[i]
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for way in (align, longest):  # what patience aligns too sparsely, a longest common subsequence may
                pairs = _dense(way(words[a:b], template), len(template)) if b - a >= needed else []
                if len(pairs) >= needed:
                    x, y = a + pairs[0][0], a + pairs[-1][0] + 1
                    yield len(pairs), name, len(pairs) / len(template), x, y
                    todo += [(a, x), (y, b)]  # a notice may come again
                    break


def _dense(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The longest stretch of pairs within twice the template's length of the text."""
    best: list[tuple[int, int]] = []
    i = 0
    for j in range(len(pairs)):
        while pairs[j][0] - pairs[i][0] >= 2 * size:
            i += 1
        if j + 1 - i > len(best):
            best = pairs[i : j + 1]
    return best


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, min_coverage: float = MIN_COVERAGE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, licenses (sorted names), places (license, coverage, first word,
    word after the last): one row for each row.

    Whole texts, in one narrow pass; a null text or one without a license has empty
    arrays, repeated rows give repeated rows. Memory follows a single text.
    """
    prepared = Templates(templates, min_coverage)
    kind = dict(docs.dtypes)[doc_id]

    def rows(ids, raws):
        found = []
        counts = []
        for raw in raws:
            words = words_of(raw)
            counts.append(len(words))
            found.append(prepared.scan(words))
        return {"doc_id": ids, "n_words": counts, "licenses": [sorted({f[0] for f in fs}) for fs in found], "places": [[dict(zip(("license", "coverage", "first", "after"), f, strict=True)) for f in fs] for fs in found]}

    return map_batches(doc_bytes(docs, text=text, doc_id=doc_id), rows, f"doc_id {kind}, n_words long, licenses array<string>, places array<struct<license:string,coverage:double,first:int,after:int>>")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
