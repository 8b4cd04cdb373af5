"""License scan: windows of the normalised text compared with license templates by the Dice coefficient over word bigrams.

Line ends, comment signs and punctuation part words and are nothing else, so a notice is found however it is wrapped. For a
template of n words the windows are runs of n words; a postings table of template bigrams gives the places at which one can
begin. A text is compared with a template only if it has enough of its bigrams: with a coefficient of d, and t bigrams in
the template, at least d * t / (2 - d), which bounds the size of the text and of the window from below.
"""

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_DICE = 0.8
# Licenses, and short notices or opening passages by which texts declare them.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Whole texts of short licenses and the usual file header of a long one, without their copyright lines.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
FULL_TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_THIRD} {_BSD_END}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
]
TEMPLATES = NOTICES + FULL_TEXTS

UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of words; all others part them.
SIGNS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in UPPER)


def words_of(text: str) -> list[bytes]:
    """Words are runs of a-z and 0-9 after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(SIGNS).split()


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


class Sliding:
    """How many different bigrams of a text lie in a window that only moves on, and how many of them a template has."""

    def __init__(self, grams: list[tuple[bytes, bytes]], wanted: set[tuple[bytes, bytes]]):
        self.grams, self.wanted, self.held = grams, wanted, Counter()
        self.start = self.end = self.shared = 0

    def move(self, start: int, end: int) -> tuple[int, int]:
        if start >= self.end:
            self.held.clear()
            self.start, self.end, self.shared = start, start, 0
        for b in self.grams[self.end : end]:
            self.held[b] += 1
            self.shared += self.held[b] == 1 and b in self.wanted
        for b in self.grams[self.start : start]:
            self.held[b] -= 1
            if not self.held[b]:
                del self.held[b]
                self.shared -= b in self.wanted
        self.start, self.end = start, max(end, self.end)
        return len(self.held), self.shared


class Templates:
    def __init__(self, templates=TEMPLATES, min_dice: float = MIN_DICE):
        self.min_dice, self.names, self.grams, self.words, self.postings = min_dice, [], [], [], {}
        for k, (name, text) in enumerate(templates):
            words = words_of(text)
            self.names.append(name)
            self.words.append(len(words))
            self.grams.append(bigrams(words))
            for b in self.grams[k]:
                self.postings.setdefault(b, []).append(k)
        # 2 * shared >= d * (a + t) and shared <= a: so many bigrams must be shared whatever the window.
        self.least = [len(own) * min_dice / (2 - min_dice) for own in self.grams]

    def windows(self, text: str) -> list[tuple[float, int, int, int]]:
        """(coefficient, words, start, template) of every window that reaches the wanted coefficient."""
        words = words_of(text)
        grams = list(zip(words, words[1:], strict=False))
        places: dict[int, list[int]] = {}
        for at, b in enumerate(grams):
            for k in self.postings.get(b, ()):
                places.setdefault(k, []).append(at)
        found = []
        for k, own in places.items():
            need, n = self.least[k] - 1e-9, self.words[k]
            if len(own) < need or len({grams[x] for x in own}) < need:
                continue
            window = Sliding(grams, self.grams[k])
            for j, start in enumerate(own):
                if bisect_left(own, start + n - 1, j) - j < need:
                    continue
                size, shared = window.move(start, min(start + n - 1, len(grams)))
                dice = 2 * shared / (size + len(self.grams[k]))
                if dice >= self.min_dice - 1e-12:
                    found.append((dice, n, start, k))
        return found

    def matches(self, text: str) -> list[tuple[float, int, int, int]]:
        """The windows that no better one overlaps: with a greater coefficient, else longer, else earlier. Versions of one
        license resemble each other, so only the nearest counts, or all that are equally near at one place."""
        found, best, starts, longest = sorted(self.windows(text), key=lambda x: (-x[0], -x[1], x[2])), [], [], max(self.words, default=0)
        for dice, n, start, k in found:
            at = bisect_left(starts, (start - longest + 1,))
            over = False
            while at < len(starts) and starts[at][0] < start + n and not over:
                other, m, d = starts[at]
                over = other + m > start and (d, m, -other) > (dice, n, -start)
                at += 1
            insort(starts, (start, n, dice))
            if not over:
                best.append((dice, n, start, k))
        return best


def _scan(templates, min_dice: float):
    def run(batches):
        known = Templates(templates, min_dice)
        for batch in batches:
            ids, names, dices, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                best, n = {}, Counter()
                for name, _, dice in {(known.names[k], start, dice) for dice, _, start, k in known.matches(text.as_py() or "")}:
                    best[name] = max(dice, best.get(name, 0.0))
                    n[name] += 1
                for name in sorted(best):
                    ids.append(doc_id), names.append(name), dices.append(round(best[name], 6)), counts.append(n[name])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(dices, pa.float64()), pa.array(counts, pa.int64())], ["doc_id", "license", "dice", "n_units"])

    return run


def license_scan(docs: DataFrame, templates=TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """A row for each document and license found in it: doc_id, license, dice (the best window's), n_units (windows that no
    better one overlaps).

    `docs` has doc_id and text; other columns are ignored. Texts without two words never match, nor does a null
    text. Long texts are read whole. Repeated rows give repeated results; an empty table gives an empty result. Rows never
    move between tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan(list(templates), min_dice), "doc_id long, license string, dice double, n_units long")
