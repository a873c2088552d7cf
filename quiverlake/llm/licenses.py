"""License notices, by DataFrame functions alone: MinHash bands over text windows, then exact containment.

Texts and templates become lower-case words without punctuation.  A template longer than
CHUNK words is cut into chunks.  Windows of a chunk's own number of words begin at every
word, and a text with fewer words than the chunk is one window of the chunk's size as a
whole, so that for each occurrence one window is aligned with it: where at least 80 % of
the chunk's five-word shingles are there, the aligned window has a Jaccard similarity of
0.8 / 1.2 = 2/3 or more, and one of BANDS bands of one MinHash each agrees with
probability 1 - (1/3)^BANDS = 0.99998.  Windows that meet a chunk in a band are verified on
the shingles themselves.

Only windows around an anchor are hashed.  Anchors are words of the templates, chosen so
that no window holds 80 % of a chunk's shingles without one of its anchors; a text without
any anchor has no windows.

Chunks of fewer than five words are one shingle.  Nulls and empty texts have no windows.
Rows with equal texts or ids are found each by itself; rows with a null id keep it.  A
very long text is cut into segments that overlap by a window, and only a window's own
words travel with it.  An empty table, or no templates, gives an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

SHINGLE, CHUNK, BANDS, LEAST = 5, 40, 10, 0.8
#: Words of a segment of a long text; all windows that begin in one are looked at together.
SEGMENT = 1000

#: Notices and licence texts to look for (public texts, quoted as their licences ask).
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "reserved": "All rights reserved.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-3-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the
names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software
must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment
in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def shingles(words: list[str]) -> list[str]:
    n = min(SHINGLE, len(words))
    return list(dict.fromkeys(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))) if words else []


def anchors(words: list[str], least: float = LEAST) -> list[str]:
    """Fewest long words whose shingles a window with `least` of all cannot do without."""
    parts, chosen, hit = shingles(words), [], set()
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        chosen.append(word)
        hit |= {s for s in parts if word in s.split()}
        if len(parts) - len(hit) < least * len(parts):
            break
    return chosen


def chunks(templates: dict[str, str]) -> list[tuple[str, int, list[str]]]:
    """(template, number of the chunk, words); the last chunk of a longer template ends with it."""
    out = []
    for name, text in templates.items():
        words = words_of(text)
        starts = [*range(0, len(words) - CHUNK, CHUNK), len(words) - CHUNK] if len(words) > CHUNK else [0]
        out += [(name, k, words[a : a + CHUNK]) for k, a in enumerate(starts) if words]
    return out


def _band_keys(hashes):
    """One key a band: the smallest hash of the shingles under the band's hash function."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def _shingle_column(words):
    n = F.least(F.lit(SHINGLE), F.size(words))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, template, chunk, containment, start_word, n_windows): each chunk found in each row, with its best window (the first of the best)."""
    spark = docs.sparkSession
    known = chunks(templates if templates is not None else TEMPLATES)
    schema = "doc_id long, template string, chunk int, containment double, start_word int, n_windows long"
    if not known:
        return spark.createDataFrame([], schema)
    rows = [F.struct(F.lit(t).alias("template"), F.lit(k).alias("chunk"), F.lit(len(w)).alias("size"), F.array(*map(F.lit, shingles(w))).alias("wanted")) for t, k, w in known]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    keys = table.select("template", "chunk", "size", "wanted", F.posexplode(_band_keys(F.col("wanted"))).alias("band", "key"))
    by_size: dict[int, set[str]] = {}
    for _, _, w in known:
        by_size.setdefault(len(w), set()).update(anchors(w, least))
    every = sorted(set().union(*by_size.values()))
    lower = F.lower("text")
    words = F.filter(F.split(lower, "[^a-z0-9]+"), lambda w: w != "")
    rows = id_and_text(docs, id_col, text_col).where(lower.rlike("|".join(every))).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", words.alias("words"))
    # Segments that overlap by a window: what a row carries along is bounded.
    most = max(by_size)
    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.size("words") / SEGMENT).cast("int")), lambda i: F.struct((i * SEGMENT).alias("base"), F.size("words").alias("total"), F.slice("words", i * SEGMENT + 1, F.lit(SEGMENT + most - 1)).alias("words")))
    parts = rows.select("row", "doc_id", F.explode(cuts).alias("s")).select("row", "doc_id", "s.*")
    # Windows that begin in a segment and hold an anchor, for each size; the window of a shorter text ends with it.
    starts = []
    for size, own in sorted(by_size.items()):
        places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*own), i)), lambda i: i.isNotNull())
        around = F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(F.lit(0), p - size + 1), p)))
        fit = F.filter(F.array_distinct(around), lambda s: (s < SEGMENT) & ((F.col("base") + s == 0) | (F.col("base") + s + size <= F.col("total"))))
        starts.append(F.transform(fit, lambda s: F.struct(F.lit(size).alias("size"), (F.col("base") + s).cast("int").alias("start"), F.slice("words", s + 1, F.lit(size)).alias("words"))))
    windows = parts.select("row", "doc_id", F.explode(F.concat(*starts)).alias("w")).select("row", "doc_id", "w.*")
    windows = windows.select("row", "doc_id", "size", "start", _shingle_column(F.col("words")).alias("own"))
    banded = windows.select("row", "doc_id", "size", "start", "own", F.posexplode(_band_keys(F.col("own"))).alias("band", "key"))
    met = banded.join(F.broadcast(keys), ["size", "band", "key"])  # at most BANDS rows for each chunk
    containment = F.size(F.array_intersect("own", "wanted")) / F.size("wanted")
    good = met.withColumn("containment", containment).where(F.col("containment") >= least)
    best = F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("best")
    found = good.groupBy("row", "doc_id", "template", "chunk").agg(best, F.count_distinct("start").alias("n_windows"))
    return found.select("doc_id", "template", "chunk", "best.containment", (-F.col("best.back")).alias("start_word"), "n_windows")
