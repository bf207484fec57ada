"""License scans by conditional compression.

Candidate blocks are found by the templates' own wording: words of the text that start a run of three words of a
template, close together and as many as a nearly complete template leaves. The block is compressed with each of
these templates as a raw zstandard dictionary; templates are ranked by how many bytes they save, and the leading
ones are confirmed (or refused) by the exact wording: an alignment of words tells which words of the template are
missing and which words of the block are extra.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Wording of public license notices, and of one-line statements, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "Released under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-disclaimer", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("MIT-disclaimer", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-disclaimer", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Licenses that a tag line names: "SPDX-License-Identifier: MIT".
SPDX_TAGS = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib"]

#: Extra words a notice may hold beside its share of extra words, templates confirmed before the best one wins, share
#: of a template's words that must be found, and words between two finds of one block.
GAP, LEADERS, COVERAGE, REACH = 2, 4, 0.9, 12
RUN = 3
_WORD = re.compile(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*")


def wording(text: str) -> list[str]:
    """Lower-case words; dots, hyphens and slashes stay inside a word."""
    return _WORD.findall(text.lower())


class LicenseScanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, tags: list[str] = SPDX_TAGS):
        self.templates = [(name, wording(text)) for name, text in [*templates, *((t, f"SPDX-License-Identifier: {t}") for t in tags)]]
        vocabulary = {w for _, t in self.templates for w in t}
        # Words that tell licenses apart must be in the block as they are: all that another template lacks.
        common = {w for w in vocabulary if sum(w in t for _, t in self.templates) > len(self.templates) // 4}
        self.telling = [[w for w in t if w not in common or len(t) < RUN] if len(t) < 20 else [] for _, t in self.templates]
        self.plain = zstandard.ZstdCompressor(level=3)
        self.with_dict = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict((" ".join(t) + " ").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in self.templates]
        # Runs of RUN words (or a whole shorter template) to the templates that hold them.
        self.runs: dict[tuple, list[int]] = defaultdict(list)
        self.pairs: dict[tuple, list[int]] = defaultdict(list)
        self.least: list[float] = []
        for k, (_, t) in enumerate(self.templates):
            index, n = (self.runs, RUN) if len(t) >= RUN else (self.pairs, 2)
            for i in range(len(t) - n + 1):
                if k not in index[tuple(t[i : i + n])]:
                    index[tuple(t[i : i + n])].append(k)
            # A missing word breaks RUN runs of the template, an extra one RUN - 1: a notice that :meth:`confirm` takes
            # has at least this many runs left.
            lost = (1 - COVERAGE) * len(t)
            distinct = len({tuple(t[i : i + n]) for i in range(len(t) - n + 1)})
            self.least.append(max(1.0, distinct - RUN * lost - (RUN - 1) * (lost + GAP)))
        self.longest = max(len(t) for _, t in self.templates)

    def blocks(self, words: list[str]) -> list[tuple[int, int, list[int]]]:
        """(first, end, templates) of candidate blocks. Finds further than ``REACH`` apart are of different blocks; a
        block longer than two of the longest templates is cut to pieces of that length that overlap by half, so that
        every notice lies in one of them and work follows the length of the text."""
        finds = [(i, k) for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if g in self.runs for k in self.runs[g]]
        finds += [(i, k) for i, g in enumerate(zip(words, words[1:], strict=False)) if g in self.pairs for k in self.pairs[g]]
        finds.sort()
        out, start, size = [], 0, 2 * (self.longest + GAP + REACH)
        for e in range(1, len(finds) + 1):
            if e < len(finds) and finds[e][0] - finds[e - 1][0] <= REACH:
                continue
            first, end = finds[start][0], finds[e - 1][0] + RUN
            for a in range(first, max(first + 1, end - size // 2), size // 2):
                piece = [f for f in finds[start:e] if a <= f[0] < a + size]
                near = Counter(k for _, k in {(tuple(words[i : i + RUN]), k) for i, k in piece})
                found = [k for k, n in sorted(near.items()) if n >= self.least[k]]
                if found:
                    out.append((max(0, a - GAP), min(len(words), a + size, end + GAP), found))
            start = e
        return out

    def ranked(self, block: list[str], templates: list[int] | None = None) -> list[tuple[int, int]]:
        """(bytes saved, template) of the given templates, most first."""
        data = " ".join(block).encode()
        alone = len(self.plain.compress(data))
        return sorted(((alone - len(self.with_dict[k].compress(data)), k) for k in (range(len(self.templates)) if templates is None else templates)), key=lambda x: (-x[0], x[1]))

    def confirm(self, block: list[str], k: int):
        """(coverage, first, end, missing words, extra words) of template k in a block, or None."""
        _, t = self.templates[k]
        match = SequenceMatcher(None, block, t, autojunk=False)
        runs = [m for m in match.get_matching_blocks() if m.size]
        # an alignment may begin or end with a stray word far off: what lies outside the dense part is no part of it
        while len(runs) > 1 and runs[0].size < RUN and runs[1].a - runs[0].a - runs[0].size > GAP:
            runs.pop(0)
        while len(runs) > 1 and runs[-1].size < RUN and runs[-1].a - runs[-2].a - runs[-2].size > GAP:
            runs.pop()
        same = sum(m.size for m in runs)
        if not runs or same < COVERAGE * len(t):
            return None
        first, end = runs[0].a, runs[-1].a + runs[-1].size
        span = block[first:end]
        if any(w not in span for w in self.telling[k]):
            return None
        matched = {i for m in runs for i in range(m.b, m.b + m.size)}
        missing = [w for i, w in enumerate(t) if i not in matched]
        inside = {i for m in runs for i in range(m.a, m.a + m.size)}
        extra = [block[i] for i in range(first, end) if i not in inside]
        if len(extra) > len(t) * (1 - COVERAGE) + GAP:
            return None
        return same / len(t), first, end, missing, extra

    def scan(self, text: str | None) -> list[dict]:
        """Every confirmed notice, in text order; notices do not overlap."""
        words, out = wording(text or ""), {}
        todo = self.blocks(words)
        while todo:
            a, b, templates = todo.pop()
            block = words[a:b]
            # The leaders compete; if the wording refuses all of them, the next that it confirms wins.
            best = None
            for at, (saved, k) in enumerate(self.ranked(block, templates)):
                if best is not None and at >= LEADERS:
                    break
                got = self.confirm(block, k)
                if got and (best is None or (len(self.templates[k][1]) * got[0], saved) > best[0]):
                    best = ((len(self.templates[k][1]) * got[0], saved), saved, k, got)
            if best is None:
                continue
            _, saved, k, (coverage, first, end, missing, extra) = best
            found = {"first_word": a + first, "words": end - first, "license": self.templates[k][0], "template": k, "saved_bytes": saved, "coverage": round(coverage, 6), "missing": missing, "extra": extra}
            # overlapping pieces of a long block can both hold a notice; the one of more words stands
            rival = next((r for r in out.values() if r["first_word"] < a + end and a + first < r["first_word"] + r["words"]), None)
            if rival is None or rival["words"] < found["words"]:
                if rival is not None:
                    del out[rival["first_word"]]
                out[found["first_word"]] = found
            for x, y in ((a, a + first), (a + end, b)):
                todo += [(x + p, x + q, t) for p, q, t in self.blocks(words[x:y])]
        return [out[k] for k in sorted(out)]


#: The scanner of the worker's last task, by its templates and tags.
_scanner: dict[tuple, LicenseScanner] = {}


def _scanner_of(templates: tuple, tags: tuple) -> LicenseScanner:
    if (templates, tags) not in _scanner:
        _scanner.clear()
        _scanner[templates, tags] = LicenseScanner(list(templates), list(tags))
    return _scanner[templates, tags]


def license_scan(docs: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, tags: list[str] = SPDX_TAGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice found: ``doc_id, first_word, words, license, template, saved_bytes, coverage, missing,
    extra, exact``; one pass, no shuffle.

    first_word counts the words of the whole text. missing and extra are the wording differences in words, as
    text; exact: there are none. Null and empty texts, and texts without a notice, give no row; repeated rows
    each give theirs; null ids are kept. Other columns are ignored. Ties between templates go to the one that
    covers more words, then saves more bytes, then comes first. ``templates`` are (license, text) of any length, complete
    license texts too; ``tags`` are the identifiers whose tag lines are notices. They go to every task.
    """
    known = tuple(map(tuple, templates)), tuple(tags)

    def run(it):
        scanner = _scanner_of(*known)
        for b in it:
            rows = [(k.as_py(), r) for k, t in zip(b.column(0), b.column(1), strict=True) for r in scanner.scan(t.as_py())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([k for k, _ in rows], pa.int64()),
                "first_word": pa.array([r["first_word"] for _, r in rows], pa.int64()),
                "words": pa.array([r["words"] for _, r in rows], pa.int32()),
                "license": pa.array([r["license"] for _, r in rows], pa.string()),
                "template": pa.array([r["template"] for _, r in rows], pa.int32()),
                "saved_bytes": pa.array([r["saved_bytes"] for _, r in rows], pa.int32()),
                "coverage": pa.array([r["coverage"] for _, r in rows], pa.float64()),
                "missing": pa.array([" ".join(r["missing"]) for _, r in rows], pa.string()),
                "extra": pa.array([" ".join(r["extra"]) for _, r in rows], pa.string()),
                "exact": pa.array([not r["missing"] and not r["extra"] for _, r in rows], pa.bool_()),
            })

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, first_word long, words int, license string, template int, saved_bytes int, coverage double, missing string, extra string, exact boolean")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
