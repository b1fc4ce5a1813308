"""Licence scans: windows of a normalised text compared with licence templates by the Dice coefficient over word bigrams.

A text and a template are normalised alike: A-Z in lower case, every run of ASCII characters that are neither letters nor
digits is a gap. Line breaks, comment marks and punctuation so fall away, and a notice is found wrapped over lines, behind
comment marks, or inside a longer line. A window has the template's length in words (the whole text, if that is shorter)
and is the set of its neighbouring word pairs; Dice is twice the shared pairs over the pairs of both.

A score of ``least`` needs set sizes within ``least / (2 - least)`` of each other, and as many shared pairs. So a template is a
candidate for a text only if the text has that share of its pairs anywhere, and a window only if it has within its own bounds;
nearly all texts have no candidate and are only cut into words once. Texts are scored where they lie, without a shuffle.

Of matching windows that overlap, one stands for the place: the one with the most shared pairs, then the highest Dice, then the
first, then the template whose name sorts first. A window is reported if no matching window that overlaps it comes before it
in that order.

Defined cases: a null text has no words; a text or template of fewer than two words has no pairs and matches nothing;
repeated rows each give their own rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from playtape.llm.decontam import words_of

# Short public licence notices and texts, by SPDX name.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty.",
    "0BSD-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
LEAST = 0.8


class Templates:
    """The templates' words and pairs by number, and what a match needs of each."""

    def __init__(self, notices: dict[str, str], least: float) -> None:
        self.least, self.words = least, {}
        self.known: list[tuple[str, int, set[int], float]] = []  # name, words, pairs, least shared pairs
        split = {name: words_of(text.encode()) for name, text in sorted(notices.items())}
        for word in sorted({w for words in split.values() for w in words}):
            self.words[word] = len(self.words)
        self.width = len(self.words)
        self.owners: dict[int, list[int]] = {}  # which templates have a pair
        for name, words in split.items():
            pairs = {self.words[a] * self.width + self.words[b] for a, b in zip(words, words[1:])}
            for pair in pairs:
                self.owners.setdefault(pair, []).append(len(self.known))
            if pairs:
                self.known.append((name, len(words), pairs, least * len(pairs) / (2 - least) - 1e-9))
        self.any = np.zeros(self.width ** 2, bool)  # for a first look at a text
        self.any[list(self.owners)] = True
        self.fewest = min((need for *_, need in self.known), default=np.inf)

    def matches(self, text: bytes | None) -> list[tuple[int, int, str, float, bytes]]:
        """(place, n_words, template, dice, said) of the windows that stand for their places."""
        words = words_of(text)
        if len(words) < 2 or not self.known:
            return []
        places = np.fromiter(map(self._number, words), np.int64, len(words))
        codes = np.where((places[:-1] < 0) | (places[1:] < 0), -1, places[:-1] * self.width + places[1:])
        known = np.unique(codes[codes >= 0])
        known = known[self.any[known]]
        if len(known) < self.fewest:
            return []
        counts = [0] * len(self.known)
        for pair in known.tolist():
            for owner in self.owners[pair]:
                counts[owner] += 1
        candidates = [t for t, held in zip(self.known, counts, strict=True) if held >= t[3]]
        return self._windows(words, codes.tolist(), candidates) if candidates else []

    def _number(self, word: bytes) -> int:
        return self.words.get(word, -1)

    def _windows(self, words: list[bytes], codes: list[int], candidates: list[tuple]) -> list[tuple]:
        numbers: dict[bytes, int] = {}
        own = [numbers.setdefault(w, len(numbers)) for w in words]
        pairs = [a * len(numbers) + b for a, b in zip(own, own[1:])]
        found = []  # shared, dice, start, stop, template
        for name, length, wanted, need in candidates:
            size = min(length, len(words)) - 1
            counts: dict[int, int] = {}
            shared = 0
            for end, pair in enumerate(pairs):
                counts[pair] = counts.get(pair, 0) + 1
                shared += counts[pair] == 1 and codes[end] in wanted
                start = end - size + 1
                if start < 0:
                    continue
                if shared >= need:
                    dice = 2.0 * shared / (len(counts) + len(wanted))
                    if dice >= self.least:
                        found.append((shared, dice, start, start + size + 1, name))
                gone = pairs[start]
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
                    shared -= codes[start] in wanted
        found.sort(key=lambda f: f[2:])
        widest = max((f[3] - f[2] for f in found), default=0)
        out, low = [], 0
        for at, one in enumerate(found):
            while found[low][2] + widest <= one[2]:
                low += 1
            near, best = low, True
            while best and near < len(found) and found[near][2] < one[3]:
                other = found[near]
                best = near == at or other[3] <= one[2] or (other[0], other[1], -other[2]) < (one[0], one[1], -one[2]) or (
                    (other[0], other[1], other[2]) == (one[0], one[1], one[2]) and other[4] > one[4])
                near += 1
            if best:
                shared, dice, start, stop, name = one
                out.append((start, stop - start, name, dice, b" ".join(words[start:stop])))
        return out


def licence_places(docs: DataFrame, notices: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, place, n_words, template, dice, said) for every place of a text that a template matches.

    ``place`` is the window's first word, counted from zero; ``said`` are its words, normalised.
    """
    given = dict(NOTICES if notices is None else notices)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(given, least)
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                found = templates.matches(text)
                rows += [i] * len(found)
                out += found
            place, size, name, dice, said = zip(*out, strict=True) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(name, pa.string()),
                 pa.array(dice, pa.float64()), pa.array(said, pa.binary()).cast(pa.string())], names=["doc_id", "place", "n_words", "template", "dice", "said"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, place int, n_words int, template string, dice double, said string")
