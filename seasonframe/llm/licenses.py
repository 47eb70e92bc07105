"""Licence scans: winnowed fingerprints find candidates, banded alignment measures them.

Templates are cut into word grams; winnowing keeps the least hash of every few neighbouring grams, and an inverted
index leads from a kept gram to its places in the templates. A document's grams that meet the index on a common
diagonal make a candidate, whose words are aligned with the template's inside a band around the diagonal,
wide enough for all the words that a match may lack or have besides.
A match needs ``min_coverage`` of the template's words in order; of matches that overlap in a document the one
with the most matched words, less its edits, is reported.

Defined results: null and empty texts have no match; a text that holds a template several times has a row for
each; repeated rows, and rows with a null key, are each reported; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SLICE_ROWS, quoted

_KEEP = bytes(c if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPANS = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
GRAM = 3
WINDOW = 4

# Whole texts of short public licences, from the grant on, and whole notices of the long ones.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = _BSD_CONDITIONS + _BSD_DISCLAIMER
_BSD_3 = _BSD_CONDITIONS + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _BSD_DISCLAIMER
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
    "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
)


def default_templates() -> dict[str, str]:
    """Licence texts and notices, by a name that begins with the licence's identifier.

    Not among them: the bodies of the Apache, GNU, Mozilla and Creative Commons licences, which a caller can give
    to ``scan_licenses`` as templates.
    """
    out = {"MIT/text": _MIT, "BSD-2-Clause/text": _BSD, "BSD-3-Clause/text": _BSD_3, "ISC/text": _ISC, "Apache-2.0/header": _APACHE, "MPL-2.0/header": _MPL, "Unlicense/text": _UNLICENSE}
    for version in ("2", "3"):
        out[f"GPL-{version}.0/header"] = _GPL.format(version)
        out[f"AGPL-{version}.0/header"] = _GPL.replace("GNU General", "GNU Affero General").format(version)
        out[f"LGPL-{version}.0/header"] = _GPL.replace("GNU General", "GNU Lesser General").format(version)
    # texts that end before the disclaimer, liability or warranty are matches of the part that they have
    for name, end in (("MIT/text", "IN NO EVENT"), ("BSD-2-Clause/text", "THIS SOFTWARE IS"), ("BSD-3-Clause/text", "THIS SOFTWARE IS"), ("ISC/text", "THE SOFTWARE IS"), ("Unlicense/text", "In jurisdictions"), ("Apache-2.0/header", "See the License")):
        out[name.replace("/", "/part-of-")] = out[name].split(end)[0].strip()
    out |= {name.replace("/", "/part-of-"): text.split("This program is distributed")[0].strip() for name, text in out.items() if "GNU" in text}
    names = {"MIT": "MIT License", "BSD": "BSD License", "ISC": "ISC License", "Apache-2.0": "Apache License, Version 2.0", "MPL-2.0": "Mozilla Public License, version 2.0"}
    for version in ("2", "3"):
        names |= {f"GPL-{version}.0": f"GNU General Public License, version {version}", f"AGPL-{version}.0": f"GNU Affero General Public License, version {version}", f"LGPL-{version}.0": f"GNU Lesser General Public License, version {version}"}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        names[f"CC-{kind}-4.0"] = f"CC {kind} 4.0"
    for k, name in names.items():
        the = "" if name.startswith("CC") else "the "
        for n, start in enumerate(("Licensed under", "Released under", "This work is licensed under", "Distributed under")):
            out[f"{k}/notice-{n + 1}"] = f"{start} {the}{name}."
    return out


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()


@dataclass(frozen=True)
class Match:
    template: int
    matched: int
    edits: int
    start: int  # words
    end: int


class TemplateIndex:
    def __init__(self, templates: dict[str, str], min_coverage: float = 0.8):
        self.names = sorted(templates)
        split = [_words(templates[n]) for n in self.names]
        if any(len(w) < GRAM for w in split):
            raise ValueError(f"templates need {GRAM} words")
        self.ids: dict[bytes, int] = {}
        self.words = [np.array([self.ids.setdefault(w, len(self.ids)) for w in ws], np.int64) for ws in split]
        self.other = len(self.ids)
        self.min_coverage = min_coverage
        # a match has n words less its gaps, and a score of half of min_coverage at least: the words it has besides
        # are at most the difference, and so are those it lacks
        self.bands = [max(8, math.ceil(len(w) * (1 - min_coverage / 2))) for w in self.words]
        found = [(code, t, at) for t, ws in enumerate(self.words) for code, at in self._winnow(ws)]
        table = np.array(sorted(found), np.int64)
        self.codes, self.template, self.place = table.T

    def _codes(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each gram, and whether templates have all its words."""
        n = len(words) - GRAM + 1
        code, known = np.zeros(max(n, 0), np.int64), np.ones(max(n, 0), bool)
        for k in range(GRAM if n > 0 else 0):
            code = code * (self.other + 1) + words[k : k + n]
            known &= words[k : k + n] != self.other
        return code, known

    def _winnow(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """Codes and places of a template's kept grams: all of a template shorter than a window."""
        code, _ = self._codes(words)
        n = len(code)
        kept = np.full(n, n < WINDOW)
        if n >= WINDOW:
            mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            parts = [slice(k, n - WINDOW + 1 + k) for k in range(WINDOW)]
            least = np.minimum.reduce([mixed[p] for p in parts])
            for p in parts:
                kept[p] |= mixed[p] == least
        return zip(code[kept].tolist(), np.flatnonzero(kept).tolist(), strict=True)

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal): where a template may begin in the words."""
        code, known = self._codes(words)
        code, at = code[known], np.flatnonzero(known)
        lo, hi = np.searchsorted(self.codes, code, "left"), np.searchsorted(self.codes, code, "right")
        n = hi - lo
        at, spot = np.repeat(at, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        template, start = self.template[spot], at - self.place[spot]
        order = np.lexsort((start, template))
        template, start = template[order], start[order]
        out = []
        bounds = [0, *(np.flatnonzero(np.diff(template)) + 1).tolist(), len(start)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if lo == hi:
                continue
            t = int(template[lo])
            band, places = self.bands[t], start[lo:hi]
            at = 0
            while at < len(places):
                # places within a quarter of a band share a diagonal; a long template needs two grams in its band
                here = int(places[at])
                near = np.searchsorted(places, here + band, "right") - np.searchsorted(places, here - band, "left")
                if near > 1 or len(self.words[t]) < 12:
                    out.append((t, here))
                at = int(np.searchsorted(places, here + band // 4, "right"))
        return out

    def align(self, words: np.ndarray, template: int, start: int) -> Match | None:
        """The best alignment of the whole template near a diagonal: most matched words less edits.

        Row i, column c: template word i against document word start + i + c - band.
        """
        pattern = self.words[template]
        band = self.bands[template] + self.bands[template] // 4
        width = 2 * band + 1
        low = -(10**6)
        score = np.zeros(width, np.int64)
        begin = start + np.arange(width) - band
        matched = np.zeros(width, np.int64)
        columns = np.arange(width)
        for i, w in enumerate(pattern):
            place = start + i + columns - band
            inside = (place >= 0) & (place < len(words))
            hit = inside & (words[np.clip(place, 0, len(words) - 1)] == w)
            # one word each, or a template word that the document lacks (from the next column)
            both = score + np.where(hit, 1, np.where(inside, -1, low))
            skip = np.append(score[1:] - 1, low)
            take = skip > both
            best = np.where(take, skip, both)
            from_ = np.where(take, np.minimum(columns + 1, width - 1), columns)
            begin_, matched_ = begin[from_], matched[from_] + (hit & ~take)
            # document words that the template lacks: along the row, one edit each
            run = np.maximum.accumulate(best + columns)
            src = np.maximum.accumulate(np.where(best + columns == run, columns, 0))
            score, begin, matched = run - columns, begin_[src], matched_[src]
        c = int(np.argmax(score))
        if matched[c] < self.min_coverage * len(pattern) or score[c] < self.min_coverage * len(pattern) / 2:
            return None
        end = start + len(pattern) + c - band
        return Match(template, int(matched[c]), int(matched[c] - score[c]), max(0, int(begin[c])), min(len(words), end))

    def scan(self, words: np.ndarray) -> list[Match]:
        found = {m for t, s in self.candidates(words) if (m := self.align(words, t, s))}
        out: list[Match] = []
        for m in sorted(found, key=lambda m: (m.edits - m.matched, m.start, m.template)):
            if all(m.end <= o.start or o.end <= m.start for o in out):
                out.append(m)
        return sorted(out, key=lambda m: m.start)


def _scan_texts(index: TemplateIndex, texts: list[str | None]) -> list[tuple]:
    rows = []
    get, other = index.ids.get, index.other
    for row, text in enumerate(texts):
        split = _words(text) if text else []
        if len(split) < GRAM:
            continue
        words = np.fromiter(map(get, split, repeat(other)), np.int64, len(split))
        code, _ = index._codes(words)
        spot = np.minimum(np.searchsorted(index.codes, code), len(index.codes) - 1)
        if not (index.codes[spot] == code).any():
            continue
        matches = index.scan(words)
        if not matches:
            continue
        spans = [m.span() for m in _SPANS.finditer(text)]
        for m in matches:
            end = min(m.end, len(spans))
            n = len(index.words[m.template])
            rows.append((row, index.names[m.template].split("/")[0], index.names[m.template], m.matched / n, m.matched, m.edits, spans[m.start][0], spans[end - 1][1]))
    return rows


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", min_coverage: float = 0.8) -> DataFrame:
    """One row a match: the key, ``license``, ``template``, ``coverage`` (share of the template's words matched in
    order), ``matched_words``, ``edits``, and the span's ``start`` and ``end`` in characters.

    Templates are parameters of the call and go to every task. A document key with the name of another output is
    called ``document_`` and that name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates or default_templates(), min_coverage))
    outputs = ("license", "template", "coverage", "matched_words", "edits", "start", "end")
    name = f"document_{key}" if key.lower() in outputs else key
    schema = T.StructType([T.StructField(name, docs.schema[key].dataType), *T._parse_datatype_string("license string, template string, coverage double, matched_words int, edits int, start int, end int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                found = _scan_texts(shared.value, batch.column(1).to_pylist())
                if found:
                    row, *rest = zip(*found, strict=True)
                    columns = [batch.column(0).take(pa.array(row))] + [pa.array(c, f.type) for c, f in zip(rest, list(made)[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=made.names)

    return docs.select(quoted(key).alias("k"), quoted(text).alias("t")).mapInArrow(run, schema)
