"""License scan by conditional compression.

Candidate blocks are runs of lines with a cue word (cue lines up to ``GAP`` lines apart are one block), with
``REACH`` words on either side, so that a wrapped notice is whole; blocks that then meet are one. The words of a
block are compressed alone and with each template's words as a raw zstandard dictionary; the bytes that a template saves
rank it. In this order every template is held against the block by its exact wording: the template's
words are aligned with the block's where they agree longest, and missing and inserted words counted. A
template is confirmed if these are at most ``TOLERANCE`` of its words; of a template under
``EXACT_UNDER`` words none may differ, and words that tell licenses apart (numbers, versions and the names in ``TELLING``)
never may. No rank is cut off: a short notice in much prose may save nothing. Every confirmed notice of a block is reported, in
order of place; one that lies within another is not, and of notices of a license that overlap otherwise, that of the greatest saving is.

Cases: a null or empty text has no block and no license; texts are read whole; equal texts
give equal results; repeated rows get a row each; null ids stay null; further columns are not read; an
empty table gives an empty result. Several blocks of one document are reported each, in order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

LEVEL, TOLERANCE, GAP, EXACT_UNDER = 9, 0.08, 3, 20
CUES = ("licens", "licenc", "copyright", "all rights reserved", "permission is hereby", "permission to use", "redistribution", "public domain", "warranty", "spdx", "as-is")

# Fixed wording of public licenses and their notices.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = _BSD + " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = _BSD_2 + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} version {} as published by the Free Software Foundation."
_WORK = "This work is licensed under the GNU {}, version {}."
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", _MIT + " " + _AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-2.0", _WORK.format(_GPL, "2")),
    ("GPL-2.0-only", _GNU_ONLY.format(_GPL, "2")),
    ("GPL-2.0-or-later", _GNU.format(_GPL, "2")),
    ("GPL-3.0", _WORK.format(_GPL, "3")),
    ("GPL-3.0-only", _GNU_ONLY.format(_GPL, "3")),
    ("GPL-3.0-or-later", _GNU.format(_GPL, "3")),
    ("LGPL-2.1", _WORK.format(_LGPL, "2.1")),
    ("LGPL-2.1-or-later", _GNU.format(_LGPL, "2.1").replace("program", "library")),
    ("LGPL-3.0", _WORK.format(_LGPL, "3")),
    ("LGPL-3.0-or-later", _GNU.format(_LGPL, "3")),
    ("AGPL-3.0", _WORK.format(_AGPL, "3")),
    ("AGPL-3.0-or-later", _GNU.format(_AGPL, "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD-2-Clause", _BSD_2 + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", _BSD_3 + _BSD_AS_IS),
    ("BSD", _BSD),
    ("ISC", _ISC),
    ("ISC", _ISC + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

#: Words that tell licenses apart: none may be missing or inserted. Nor may a template's word with a digit be missing; an inserted one may be the number of a clause.
TELLING = frozenset("affero apache attribution-sharealike boost bsd cc commons eclipse general gnu gpl isc later lesser lgpl library mit mozilla mpl neither noncommercial only public sharealike".split())

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

#: Words around a cue that a template, with what may be inserted, can take up.
REACH = max(len(_WORD.findall(t.lower())) for _, t in TEMPLATES) * 6 // 5


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Match:
    """A license found in a block: the block's place, bytes that the template saves on its words, differing words and what they are."""

    license: str
    start: int
    end: int
    saved: int
    block_bytes: int
    differing: int
    differences: str


def candidate_blocks(text: str, reach: int = REACH) -> list[tuple[int, int]]:
    """Start and end of the runs of lines that hold cues, each with ``reach`` words on either side."""
    if not any(c in text.lower() for c in CUES):
        return []
    lines, starts, at = text.split("\n"), [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    runs: list[list[int]] = []
    for i, line in enumerate(lines):
        if any(c in line.lower() for c in CUES):
            if runs and i - runs[-1][1] <= GAP:
                runs[-1][1] = i
            else:
                runs.append([i, i])
    out: list[list[int]] = []
    for first, last in runs:
        begin, end = widened(lines, starts, first, -1, reach), widened(lines, starts, last, 1, reach)
        if out and begin <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def widened(lines: list[str], starts: list[int], i: int, step: int, reach: int) -> int:
    """Where ``reach`` words before (``step`` -1) or after line ``i`` end, or the text's lines do."""
    at, seen, i = starts[i] if step < 0 else starts[i] + len(lines[i]), 0, i + step
    while 0 <= i < len(lines) and seen < reach:
        found = [(m.start(), m.end()) for m in re.finditer(_WORD.pattern, lines[i], re.I | re.A)]
        some = found[seen - reach :] if step < 0 else found[: reach - seen]
        if some:
            at, seen = starts[i] + (some[0][0] if step < 0 else some[-1][1]), seen + len(some)
        i += step
    return at


@lru_cache(2)
def compressors(templates: tuple[tuple[str, str], ...]):
    alone = zstandard.ZstdCompressor(level=LEVEL)
    return alone, [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(" ".join(words(t)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in templates]


def savings(block: list[str], templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[int]:
    """Bytes that each template saves on a block's words: compressed alone, less compressed with the template."""
    alone, with_template = compressors(templates)
    raw = " ".join(block).encode()
    size = len(alone.compress(raw))
    return [size - len(c.compress(raw)) for c in with_template]


def wording(template: list[str], region: list[str]) -> tuple[int, str, int, int]:
    """How many words differ between template and region, which (missing as -, inserted as +), and the region's words that it takes up."""
    steps = [s for s in SequenceMatcher(None, template, region, autojunk=False).get_opcodes()]
    said: list[str] = []
    for n, (kind, a, b, c, d) in enumerate(steps):
        if kind != "equal":
            said += [f"-{w}" for w in template[a:b]]
            if 0 < n < len(steps) - 1:  # what stands before or after the template isn't an insertion
                said += [f"+{w}" for w in region[c:d]]
    same = [(c, d) for kind, _, _, c, d in steps if kind == "equal"] or [(0, 0)]
    return len(said), " ".join(said), same[0][0], same[-1][1]


def telling(change: str) -> bool:
    """Whether a missing (-) or inserted (+) word tells licenses apart."""
    return change[1:] in TELLING or (change[0] == "-" and any(c.isdigit() for c in change))


def occurrences(template: list[str], block: list[str]) -> list[tuple[int, int, int, str]]:
    """First and last word, differing words and what they are, of every place where the block confirms the template."""
    size, known = len(template), set(block)
    allowed = int(TOLERANCE * size) if size >= EXACT_UNDER else 0
    if sum(w not in known for w in template) > allowed:
        return []
    if not allowed:
        at = [i for i, w in enumerate(block) if w == template[0] and block[i : i + size] == template]
        return [(i, i + size, 0, "") for i in at]
    out, parts, least, slack = [], [(0, len(block))], (size - allowed) // (allowed + 1), size // 5
    while parts:
        lo, hi = parts.pop()
        longest = SequenceMatcher(None, template, block, autojunk=False).find_longest_match(0, size, lo, hi)
        if longest.size < max(1, least):
            continue
        first = longest.b - longest.a
        begin = max(lo, first - slack)
        differing, said, a, b = wording(template, block[begin : min(hi, first + size + slack)])
        if differing <= allowed and not any(map(telling, said.split())):
            out.append((begin + a, begin + b, differing, said))
            parts += [(lo, begin + a), (begin + b, hi)]
        else:
            parts += [(lo, longest.b), (longest.b + longest.size, hi)]
    return out


def scan_block(text: str, start: int, end: int, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[Match]:
    """The licenses of a block whose wording is confirmed, in order of place."""
    mine = words(text[start:end])
    saved = savings(mine, templates)
    kept: list[tuple] = []
    for i in sorted(range(len(templates)), key=lambda i: (-saved[i], i)):
        name = templates[i][0]
        for a, b, differing, said in sorted(occurrences(words(templates[i][1]), mine)):
            met = [k for k in kept if a < k[1] and k[0] < b]
            within = [k for k in met if a <= k[0] and k[1] <= b and (k[0], k[1]) != (a, b)]
            if not any(k not in within and (k[2] == name or (k[0] <= a and b <= k[1])) for k in met):
                kept = [k for k in kept if k not in within]
                kept.append((a, b, name, i, differing, said))
    size = len(text[start:end].encode())
    return [Match(name, start, end, saved[i], size, differing, said) for _, _, name, i, differing, said in sorted(kept)]


def scan_text(text: str | None, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[int, list[Match]]:
    """Number of candidate blocks, and every license confirmed in them."""
    blocks = candidate_blocks(text or "")
    return len(blocks), [m for a, b in blocks for m in scan_block(text, a, b, templates)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """id, n_blocks and matches (license, start, end, saved, block_bytes, differing, differences) of every row: one map, no shuffle."""
    fields = [("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.int64()), ("block_bytes", pa.int64()), ("differing", pa.int64()), ("differences", pa.string())]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [scan_text(t.as_py(), templates) for t in batch.column(1)]
            made = pa.array([[vars(m) for m in found] for _, found in got], pa.list_(pa.struct(fields)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), made], ["id", "n_blocks", "matches"])

        return each

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(picked, make, "id long, n_blocks long, matches array<struct<license: string, start: long, end: long, saved: long, block_bytes: long, differing: long, differences: string>>")
