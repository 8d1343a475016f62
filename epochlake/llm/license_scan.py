"""License scans (operator 3): sparse TF-IDF cosine to templates, inheritance from the nearest ancestor directory.

``own_licenses`` compares stretches of a file with templates of licences: whole notices, headers, titles and SPDX lines.
Words are runs of letters and digits in lower case, so comment marks and line wraps don't count. A stretch starts at a line or
sentence and has as many words as the template, across lines; templates of up to ``SHORT`` words must fill a line of
their own. Every word's document frequency is counted over all files, by tasks and Spark, and written as sorted hash arrays that
workers map; a word's weight is 1 - log(share of files + ``SMOOTH``), which doesn't change as a collection grows. A
file's own licence is the template of the highest cosine, if that reaches ``min_cosine``. Only stretches whose bound from
prefix sums reaches the limit are weighed exactly.

``inherit`` gives files without one the licence of the nearest directory above that holds a licence file, by equi-joins
of paths with their ancestors.

Defined results: null or empty texts have no own licence. Equal cosines go to the template that stands first. A null
path has no ancestors; of several licence files in a directory the highest cosine counts, then the licence's name.
Repeated rows stay. Extra columns are carried along; names that the result adds are refused in the input. A text is
taken whole: n bytes take some 60 n in the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, refuse_columns, small_batches
from .hash_arrays import HashTable, worker_cache, write_table
from .word_hashes import END, token_chunks

MIN_COSINE = 0.7
#: Added to a word's share of files: what is rarer weighs no more.
SMOOTH = 0.05
#: Templates of so many words, or fewer, must be a line of their own.
SHORT = 4
#: Words that a task counts together; distinct words per shard.
FLUSH_TOKENS, SHARD_ROWS = 1_000_000, 2_000_000
#: Licence directories up to this number are broadcast; above it the join is salted.
BROADCAST_DIRECTORIES = 200_000
SALTS = 32
BREAK = "\x02"
#: Licences whose identifier lines are known, by SPDX identifier.
IDENTIFIERS = ["AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
#: Parts that several public licences share.
WARRANTY_MIT = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
WARRANTY_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
GRANT_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
GRANT_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
ENDORSE_BSD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GNU_TERMS = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GNU_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details."
GPL, LGPL, AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
#: Notices, headers and titles of public licences, by SPDX identifier.
TEMPLATES = [
    *((i, f"SPDX-License-Identifier: {i}") for i in IDENTIFIERS),
    *((i, f"SPDX-License-Identifier: {i}-{kind}") for i in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for kind in ("only", "or-later")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", f"{GRANT_BSD} {WARRANTY_BSD}"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", f"{GRANT_BSD} {ENDORSE_BSD} {WARRANTY_BSD}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", GNU_TERMS.format(GPL, 2) + " " + GNU_WARRANTY.format(GPL)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", GNU_TERMS.format(GPL, 3) + " " + GNU_WARRANTY.format(GPL)),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", GNU_TERMS.format(LGPL, 2.1) + " " + GNU_WARRANTY.format(LGPL)),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", GNU_TERMS.format(LGPL, 3) + " " + GNU_WARRANTY.format(LGPL)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", GNU_TERMS.format(AGPL, 3) + " " + GNU_WARRANTY.format(AGPL)),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", f"{GRANT_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {WARRANTY_MIT}"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]


def plain(texts: pa.Array) -> pa.Array:
    """Texts as words between single spaces, with a BREAK word at each end of a line or sentence."""
    texts = pc.replace_substring_regex(pc.fill_null(texts, ""), r"[.!?][ \t]+", "\n")
    texts = pc.replace_substring_regex(texts, r"[^\pL\pN\n]+", " ")
    return pc.replace_substring(texts, "\n", f" {BREAK} ")


def _break_hash() -> np.uint64:
    return next(token_chunks(pa.array([BREAK])))[2][0]


def weights(share: np.ndarray) -> np.ndarray:
    """A word's weight from its share of files."""
    return 1 - np.log(share + SMOOTH)


class Templates:
    """Sorted word hashes of all templates and, once shares are known, a unit vector per template."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        mark = _break_hash()
        words = [next(token_chunks(plain(pa.array([t]))))[2] for _, t in templates]
        self.words = [w[(w != END) & (w != mark)] for w in words]
        self.length = np.array([len(w) for w in self.words])
        self.vocabulary = np.unique(np.concatenate(self.words))

    def weigh(self, weight: np.ndarray, min_cosine: float) -> None:
        self.matrix = np.zeros((len(self.vocabulary), len(self.names)))
        for t, words in enumerate(self.words):
            word, n = np.unique(words, return_counts=True)
            at = np.searchsorted(self.vocabulary, word)
            self.matrix[at, t] = n * weight[at]
        self.matrix /= np.linalg.norm(self.matrix, axis=0)
        order = np.argsort(weight, kind="stable")
        reach = np.sqrt(np.cumsum(self.matrix[order] ** 2, axis=0)).max(axis=1)
        #: Words without which a stretch stays under the limit to every template: those past the commoner ones that don't reach it alone.
        self.telling = np.ones(len(self.vocabulary), bool)
        self.telling[order[reach < min_cosine]] = False


def document_frequencies(texts: DataFrame) -> DataFrame:
    """Rows (word, n): in how many files each word stands, and how many files there are at word 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, files, mark = [np.zeros(0, np.uint64)], 0, 0, _break_hash()

        def flushed() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            word, n = np.append(word[word != mark], np.uint64(0)), np.append(n[word != mark], files)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            files += batch.num_rows
            for first, last, token, row in token_chunks(plain(batch.column(0))):
                order = np.lexsort((token, row))
                t, r = token[order], row[order]
                fresh = np.concatenate([[True], (t[1:] != t[:-1]) | (r[1:] != r[:-1])])
                held.append(t[fresh & (t != END)])
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield flushed()
                    held, size, files = [np.zeros(0, np.uint64)], 0, 0
        yield flushed()

    return texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Weighed:
    """Templates with weights, and the shares of all words, as a worker holds them."""

    def __init__(self, uri: str, shards: int, templates: list[tuple[str, str]], min_cosine: float):
        self.shares = HashTable(uri, shards, 1)
        self.templates = Templates(templates)
        self.templates.weigh(self.weight(self.templates.vocabulary), min_cosine)
        self.mark = _break_hash()

    def weight(self, words: np.ndarray) -> np.ndarray:
        return weights(self.shares.find(words)[1][:, 0].astype(np.float64))

    def best(self, texts: pa.Array, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, template) of each text's best stretch; template -1 if none reaches the limit."""
        cosine, which = np.zeros(len(texts)), np.full(len(texts), -1)
        t = self.templates
        for first, last, token, row in token_chunks(plain(texts)):
            word = (token != END) & (token != self.mark)
            start = word & np.concatenate([[True], ~word[:-1]])
            kind, at = np.unique(token[word], return_inverse=True)
            place = np.minimum(np.searchsorted(t.vocabulary, kind), len(t.vocabulary) - 1)
            known = t.vocabulary[place] == kind
            own = np.zeros(last - first, bool)
            own[row[word][(known & t.telling[place])[at]] - first] = True
            word &= own[row - first]
            if not word.any():
                continue
            heads, owner = start[word], row[word]
            kind, at = np.unique(token[word], return_inverse=True)
            place = np.minimum(np.searchsorted(t.vocabulary, kind), len(t.vocabulary) - 1)
            known = t.vocabulary[place] == kind
            weight = self.weight(kind)
            share = np.where(known[:, None], weight[:, None] * t.matrix[place], 0.0)
            n = len(owner)
            square = np.concatenate([[0.0], np.cumsum(weight[at] ** 2)])
            begins = np.flatnonzero(heads)
            line_end = np.append(begins[1:], n)
            file_end = np.searchsorted(owner, owner[begins], "right")
            for k, length in enumerate(t.length):
                dots = np.concatenate([[0.0], np.cumsum(share[at, k])])
                ends = np.minimum(begins + length, file_end)
                bound = (dots[ends] - dots[begins]) / np.sqrt(square[ends] - square[begins])
                good = bound >= min_cosine - 1e-9
                if length <= SHORT:
                    good &= line_end - begins == length
                for j in np.flatnonzero(good).tolist():
                    a, b = begins[j], ends[j]
                    w, times = np.unique(at[a:b], return_counts=True)
                    value = (dots[b] - dots[a]) / np.linalg.norm(times * weight[w])
                    r = owner[a]
                    if value >= min_cosine and (value > cosine[r] + 1e-12 or which[r] < 0):
                        cosine[r], which[r] = value, k
        return cosine, which


def own_licenses(files: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, min_cosine: float = MIN_COSINE, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` and ``own_license``, ``cosine`` of the best stretch (null if under the limit)."""
    spark = files.sparkSession
    small_batches(spark)
    keep = [c for c in files.columns if c != text] if keep is None else keep
    refuse_columns(keep, ["own_license", "cosine", "license", "inherited_from", "__text"])
    source = files.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    counts = cut(document_frequencies(source.select("__text")))
    total = counts.filter("word = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    uri, shards = fresh_path(spark, "word-shares"), max(1, counts.count() // SHARD_ROWS)
    write_table(counts.filter("word <> 0").select(F.col("word").alias("key"), F.array((F.col("n") / F.lit(max(total, 1))).cast("float")).alias("v")), uri, shards, 1)
    names = np.array([n for n, _ in templates], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_cache(uri, lambda: Weighed(uri, shards, templates, min_cosine))
        for batch in batches:
            cosine, which = model.best(batch.column(0), min_cosine)
            none = which < 0
            kept = [batch.column(k) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.where(none, None, names[which]).tolist(), pa.string()), pa.array(cosine, mask=none)], names=[*batch.schema.names[1:], "own_license", "cosine"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("__text").schema)
    return source.mapInArrow(run, f"{schema}, own_license string, cosine double")


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first: a/b/c has a/b, a and the root ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, F.size(parts) - k), "/"))


def inherit(files: DataFrame, path: str = "path", is_license_file: str = "is_license_file") -> DataFrame:
    """Adds ``license`` (own, else inherited), ``inherited_from`` (directory or null). Columns of these names, or of names that start with ``__``, are refused."""
    refuse_columns(files.columns, ["license", "inherited_from", *(c for c in files.columns if c.startswith("__"))])
    files = cut(files)
    directory = F.regexp_replace(path, "/?[^/]*$", "")
    holding = files.filter(F.col(is_license_file) & F.col("own_license").isNotNull() & F.col(path).isNotNull())
    rules = holding.groupBy(directory.alias("dir")).agg(F.min_by("own_license", F.struct(-F.col("cosine"), "own_license")).alias("given"))
    homes = files.filter(F.col(path).isNotNull() & F.col("own_license").isNull()).select(directory.alias("__home")).distinct()
    above = homes.select("__home", F.posexplode(ancestors(F.concat("__home", F.lit("/x")))).alias("up", "dir"))
    small = rules.limit(BROADCAST_DIRECTORIES + 1).count() <= BROADCAST_DIRECTORIES
    nearest = above.join(F.broadcast(rules) if small else rules, "dir").groupBy("__home").agg(F.min_by(F.struct("dir", "given"), "up").alias("__near"))
    if nearest.limit(BROADCAST_DIRECTORIES + 1).count() <= BROADCAST_DIRECTORIES:
        joined = files.withColumn("__home", directory).join(F.broadcast(nearest), "__home", "left")
    else:
        salted = nearest.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = files.withColumn("__home", directory).withColumn("__salt", F.pmod(F.xxhash64(path), F.lit(SALTS)).cast("int")).join(salted, ["__home", "__salt"], "left").drop("__salt")
    near = F.when(F.col("own_license").isNull(), F.col("__near"))
    return joined.select(*[F.col(f"`{c}`") for c in files.columns], F.coalesce("own_license", near["given"]).alias("license"), near["dir"].alias("inherited_from"))
