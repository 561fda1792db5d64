"""License notices by conditional compression.

A text is a candidate where it has a cue word.  Around each cue, and for each template, the
block of the template's size is compressed twice with zstandard: alone, and with the template
as a raw dictionary.  The bytes saved, as a share of what the template itself costs, rank the
templates; all that save enough are compared with the block word by word, and the one with the
most words and fewest differences wins if they are few enough and none is in a number or a
telling word.

The cue test runs in the JVM and lets only candidate texts through to Python.  There, a template
is tried only on texts that have all its words but for as many as may differ, and equal blocks of
a text are judged once, so that a text full of cue words costs little more than its length.

Defined cases: null, empty and cue-less texts have no notice; notices that overlap count
once, the longest first; of equally good templates the one with the larger gain wins, then the first; very
long texts are searched whole; repeated rows give repeated results; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

CUE = r"licen[sc]|copyright|permission|rights\s+reserved|public\s+domain|spdx|warrant|redistribut|creative\s+commons|cc\s+by|cc0|as-is|©"
#: A template is looked at when at least this share of it is found by compression.
LEAST_GAIN = 0.4
#: One difference in wording is allowed for so many words of a template.
WORDS_A_DIFFERENCE = 20

#: Short notices, opening paragraphs and whole texts of public licenses, by SPDX name.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_REST = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_REST = " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_APACHE = "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_REST = " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", _MIT, _MIT + _MIT_REST],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", _APACHE, "Licensed under the Apache License, Version 2.0 (the \"License\"); " + _APACHE + _APACHE_REST],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD License"],
    "BSD-2-Clause": [_BSD_2 + _BSD_REST],
    "BSD-3-Clause": [_BSD_2 + _BSD_THIRD + _BSD_REST],
    "ISC": [_ISC, _ISC + _ISC_REST],
    "Zlib": [_ZLIB],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Licensed under CC0 1.0"],
    "Unlicense": [_UNLICENSE, _UNLICENSE + _UNLICENSE_REST],
    "Proprietary": ["All rights reserved"],
}
_TELLING = {"nc", "nd", "sa", "lesser", "affero", "general", "mit", "apache", "bsd", "gnu", "mozilla", "sharealike", "noncommercial", "noderivatives"}
_WORD = re.compile(r"\w+")


@lru_cache(maxsize=1)
def _templates():
    import zstandard

    plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            low = text.lower()
            raw = zstandard.ZstdCompressionDict(low.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            cost = len(plain.compress(low.encode())) - len(plain.compress(b""))
            out.append((name, low, _WORD.findall(low), zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False), cost))
    return plain, out


def differences(template: list[str], words: list[str]) -> tuple[int, int, list[str], list[str]]:
    """First and last (exclusive) word of the part of ``words`` that is nearest to the template, the template's words that it lacks, and those it has beside them."""
    n, m = len(template), len(words)
    number = {w: i for i, w in enumerate(dict.fromkeys(template))}
    of = np.array([number.get(w, -1) for w in words], np.int64)
    # alignment cost of template[:i] with a part of words that ends at j; a part may begin anywhere
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0] = np.arange(n + 1)
    for i in range(1, n + 1):
        same = of == number[template[i - 1]]
        row = np.minimum(np.where(same, cost[i - 1, :-1], 1 << 20), cost[i - 1, 1:] + 1)
        # extra words cost one each: a running minimum of cost - place
        whole = np.concatenate([[cost[i, 0]], row]) - np.arange(m + 1)
        cost[i] = np.minimum.accumulate(whole) + np.arange(m + 1)
    j = end = int(cost[n].argmin())
    i, lacks, extra = n, [], []
    while i:
        if j and words[j - 1] == template[i - 1] and cost[i, j] == cost[i - 1, j - 1]:
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            lacks.append(template[i])
        else:
            j -= 1
            extra.append(words[j])
    return j, end, lacks[::-1], extra[::-1]


def _judge(plain, template, block: str) -> tuple | None:
    """How good a template is for a block (differences beyond its words, gain lost), and the notice; None where it saves too little or its wording differs too much."""
    name, _, words, compressor, cost = template
    data = block.encode()
    gain = (len(plain.compress(data)) - len(compressor.compress(data))) / cost
    if gain < LEAST_GAIN:
        return None
    at = [(m.start(), m.end()) for m in _WORD.finditer(block)]
    i, j, lacks, extra = differences(words, [block[x:y] for x, y in at])
    wrong = lacks + extra
    if j <= i or len(wrong) > len(words) // WORDS_A_DIFFERENCE or any(w in _TELLING or any(c.isdigit() for c in w) for w in wrong):
        return None
    return len(wrong) - len(words), -gain, {"license": name, "start": at[i][0], "end": at[j - 1][1], "gain": gain, "lacks": " ".join(lacks), "extra": " ".join(extra)}


def notices(text: str) -> list[dict]:
    """License, start and end (code points), gain and differing words of each notice in a text."""
    plain, templates = _templates()
    low = "".join(x if len(x) == 1 else c for c, x in zip(text, map(str.lower, text), strict=True)) if len(text.lower()) != len(text) else text.lower()
    has = set(_WORD.findall(low))
    tried = [k for k, (_, _, words, _, _) in enumerate(templates) if len(set(words) - has) <= len(words) // WORDS_A_DIFFERENCE]
    found = []
    done = 0
    judged: dict[tuple[int, str], tuple | None] = {}
    for cue in re.finditer(CUE, low) if tried else ():
        if cue.start() < done:  # inside the notice before
            continue
        best = None
        for k in tried:
            a, b = max(0, cue.start() - len(templates[k][1])), min(len(low), cue.end() + len(templates[k][1]))
            block = low[a:b]
            if (k, block) not in judged:
                judged[k, block] = _judge(plain, templates[k], block)
            one = judged[k, block]
            if one and (best is None or one[:2] < best[0][:2]):
                best = one, a
        if best:
            (_, _, x), a = best
            found.append(x | {"start": x["start"] + a, "end": x["end"] + a})
            done = found[-1]["end"]
    kept: list[dict] = []
    for x in sorted(found, key=lambda x: (x["start"] - x["end"], x["start"], x["license"])):
        if all(x["end"] <= y["start"] or y["end"] <= x["start"] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x["start"])


_FIELDS = [("license", "string"), ("start", "long"), ("end", "long"), ("gain", "double"), ("lacks", "string"), ("extra", "string")]
_ARROW = pa.list_(pa.struct([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t]) for n, t in _FIELDS]))


def is_candidate(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?iu){CUE}"), F.lit(False))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_notices, licenses (names in order of place), notices (license, start, end, gain, lacks, extra)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("notices", T.ArrayType(T.StructType([T.StructField(n, {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType()}[t]) for n, t in _FIELDS])))])

    def work(batches):
        for batch in batches:
            for a, b in W.row_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([notices(t) if t else [] for t in part.column(1).to_pylist()], _ARROW)], names=schema.names)

    found = docs.select("doc_id", F.when(is_candidate(F.col("text")), F.col("text")).alias("text")).mapInArrow(work, schema)
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join(F.transform("notices", lambda x: x["license"]), ",").alias("licenses"), "notices")
