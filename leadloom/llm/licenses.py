"""Licence scan: passages compared with licence templates by the Dice coefficient over word bigrams.

Texts are normalised (letters folded, punctuation and copyright lines dropped). A passage is any run of words, across
lines and paragraphs; as a set of word bigrams it is compared with the templates: ``2 * common / (|passage| +
|template|)``. A passage of ``n`` bigrams can only reach ``threshold`` ``t`` with templates of ``n * t / (2 - t)`` to
``n * (2 - t) / t`` bigrams, and has at least ``size * t / (2 - t)`` of theirs. So, in steps:

1. A text that has fewer of a template's bigrams, wherever they stand, has no such passage: one look-up of all its bigrams in
   a sorted list of all templates' bigrams leaves hardly a text and template.
2. In those left, passages that begin and end with a bigram of the template are grown from each beginning, as long as
   the bounds let them; other ends would only lower the value.
3. Of the passages at the threshold the best is reported, then the best that does not overlap it, and so on.

Every text is scanned; there is no shuffle. Templates are a fixed list, so sent whole.

Defined results: a null or empty text has no rows. Of passages with the same value the one of the larger template
counts, then the first by name, then the shortest, then the first in the text. Very long texts are read whole. Repeated
rows have their own rows, null ids are kept. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common
from leadloom.llm.decontam import BREAKS

THRESHOLD = 0.8

# Public licence texts and the notices in use for them.
TEMPLATES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
            "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
            "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
            "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
            "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
            "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
            "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
            "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
            "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
            "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
            "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
            "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
            "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE "
            "IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
            "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
            "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
            "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
            "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
            "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
            "express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
            "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
            "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
            "PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
            "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
            "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
            "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We "
            "intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright "
            "law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
            "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
            "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
            "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
            "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
            "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
            "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
_NOTICE = re.compile(rb"(?i)copyright\b|\(c\)|\xc2\xa9")


class Templates:
    """Templates as sorted numbers of their word bigrams, and which templates have a bigram."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        words = [words_of(text.encode())[0] for _, text in templates]
        sets = sorted(((np.unique(common.windows(w, 2)), name) for (name, _), w in zip(templates, words)), key=lambda x: (len(x[0]), x[1]))
        self.names, self.grams = [x[1] for x in sets], [x[0] for x in sets]
        self.sizes = [len(g) for g in self.grams]
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        every = np.concatenate(self.grams)
        order = np.lexsort((owners, every))
        self.every, self.owners = every[order], owners[order]
        self.least = np.array([self.fewest(s) for s in self.sizes])

    def fewest(self, size: int) -> int:
        """Bigrams of a template that a passage at the threshold has at least."""
        return int(np.ceil(size * self.threshold / (2 - self.threshold) - 1e-9))

    def candidates(self, grams: np.ndarray, spare: int) -> np.ndarray:
        """Templates of which a text has enough bigrams; ``spare``: those it may gain when lines are left out."""
        own = np.unique(grams)
        low, high = np.searchsorted(self.every, own, "left"), np.searchsorted(self.every, own, "right")
        low, high = low[high > low], high[high > low]
        counts = np.zeros(len(self.names), np.int64)
        for a, b in zip(low.tolist(), high.tolist()):
            counts[self.owners[a:b]] += 1
        return np.flatnonzero(counts + spare >= self.least) if counts.any() else counts[:0]


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the normalised words of a text without its copyright lines, and the line each stands in."""
    numbers, lines = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    parts = raw.split(b"\n")
    plain = [i for i, line in enumerate(parts) if not _NOTICE.match(line.lstrip(b" \t\r\x0b\x0c/*#-"))]
    found = common.Words(pa.array([parts[i] for i in plain], pa.binary()).cast(pa.string(), safe=False) if plain else pa.array([], pa.string()), skip=BREAKS)
    if plain:
        numbers.append(found.numbers())
        lines.append(np.repeat(np.array(plain, np.int64), np.diff(found.bounds)))
    return np.concatenate(numbers), np.concatenate(lines)


def passages(grams: np.ndarray, own: np.ndarray, threshold: float) -> list[tuple[float, int, int]]:
    """(Dice, first, last bigram) of the best passage from each beginning, for one template's sorted bigrams.

    A passage ends before its first bigram comes again: what goes on is as good without its beginning, and shorter.
    """
    size, out = len(own), []
    place = np.minimum(np.searchsorted(own, grams), size - 1)
    hit = own[place] == grams
    starts = np.flatnonzero(hit).tolist()
    most = int(np.floor(size * (2 - threshold) / threshold + 1e-9))
    values, is_hit = grams.tolist(), hit.tolist()
    for start in starts:
        seen, common_, best = set(), 0, None
        for end in range(start, len(values)):
            if end > start and values[end] == values[start]:
                break
            if values[end] not in seen:
                seen.add(values[end])
                if len(seen) > most:
                    break
                common_ += is_hit[end]
            if is_hit[end]:
                dice = 2 * common_ / (len(seen) + size)
                if dice >= threshold - 1e-9 and (best is None or dice > best[0]):
                    best = (dice, start, end)
        if best:
            out.append(best)
    return out


def scan_text(raw: bytes, templates: Templates) -> list[tuple[int, int, int, int, str, float]]:
    """(first line, last line, first word, words, licence, Dice) of the passages with a licence, in order."""
    numbers, lines = words_of(raw)
    grams = common.windows(numbers, 2)
    found = []
    for i in templates.candidates(grams, 0).tolist():
        found += [(-dice, -templates.sizes[i], templates.names[i], b - a, a, b) for dice, a, b in passages(grams, templates.grams[i], templates.threshold)]
    out: list[tuple] = []
    for dice, _, name, _, a, b in sorted(found):
        if all(b + 1 < first or a > first + n - 1 for _, _, first, n, _, _ in out):
            out.append((int(lines[a]), int(lines[b + 1]), a, b - a + 2, name, -dice))
    return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, first_line, last_line, first_word, words, licence, dice``: one row per passage of a text that a template fits."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
        for batch in common.chunks(batches, "text"):
            words = common.Words(batch.column(1), skip=BREAKS)
            grams = common.windows(words.numbers(), 2)
            at = np.minimum(np.searchsorted(known.every, grams), len(known.every) - 1)
            hits = np.concatenate(([0], np.cumsum(known.every[at] == grams)))
            raw, out = words.raw, []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                a, b = int(words.bounds[i]), int(words.bounds[i + 1])
                if b - a < 2 or hits[b - 1] == hits[a]:
                    continue
                own = grams[a:b - 1]
                own = own[known.every[at[a:b - 1]] == own]
                text_ = raw[words.at[i]:words.at[i + 1]].tobytes()
                if len(known.candidates(own, len(_NOTICE.findall(text_)))):
                    out += [(doc, *row) for row in scan_text(text_, known)]
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "first_line", "last_line", "first_word", "words", "licence", "dice"])

    return rows.mapInArrow(run, "doc_id long, first_line int, last_line int, first_word int, words int, licence string, dice double")
