"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies, in DataFrame functions.

Texts and templates are shingled by SHINGLE words, lower-cased and without punctuation. A template of fewer words is one shingle
of all its words, and texts are shingled by runs of that length too, for such templates alone. For a template of m shingles, a text's
windows are 2m shingles long and start every m, so any run of m shingles lies whole inside one. A window that holds a share
CONTAINED of the template has a Jaccard similarity of at least CONTAINED * m / (2m + m - CONTAINED * m) = 0.36, and HASHES
bands of one row miss it with probability (1 - 0.36)^32 < 1e-6.

A window can only agree with a template in a band if it holds that template's least shingle of the band. So the shingles are
joined with the templates' least shingles first (HASHES rows a template), and band values are computed for the windows around
those hits alone: the same candidates as from banding every window, at the cost of one pass over the text.

Defined results: null and empty texts, and texts shorter than a template's shingle, match nothing; a template without a word
raises an error; repeated rows are reported each; null ids pass through; an empty
table, or no templates, gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE_CLASS, text_of

SHINGLE = 5
HASHES = 32
CONTAINED = 0.8

#: Notices by which texts state their license.
TEMPLATES = [
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

#: Whole license texts, which documents may hold altered or in part.
TEXTS = [
    (
        "MIT-full",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC-full",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause-conditions",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "Apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
]

#: The same as TEMPLATES of fewer than SHINGLE words.
SHORT_TEMPLATES = [("All-rights-reserved", "All rights reserved.")]


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES + TEXTS + SHORT_TEMPLATES, "license string, text string")


def _words(text: Column) -> Column:
    """array<long>: a hash of each word."""
    return F.transform(F.array_remove(F.split(F.regexp_replace(F.lower(text), r"""[.,;:()"']""", ""), WHITE_CLASS + "+"), ""), lambda w: F.xxhash64(w))


def _shingles(words: Column, lengths: list[int]) -> Column:
    """array<struct<run, shingles>>: for each run length a hash of each run of so many words."""

    def runs(h: Column, length: int) -> Column:
        each = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, length)]))
        return F.struct(F.lit(length).alias("run"), F.slice(each, F.lit(1), F.greatest(F.size(h) - (length - 1), F.lit(0))).alias("shingles"))

    return F.element_at(F.transform(F.array(words), lambda h: F.array(*[runs(h, n) for n in lengths])), 1)


def _bands(shingles: Column) -> Column:
    """array<long>: for each of HASHES hash functions the least value over the shingles."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(k))))

    return F.array(*map(least, range(HASHES)))


def scan_licenses(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, license, containment, n_windows, first_word: for each text and the templates that it holds."""
    own = templates.select("license", _words(text_of()).alias("words"))
    own = own.withColumn("length", F.least(F.size("words"), F.lit(SHINGLE)))
    lengths = sorted(r[0] for r in own.select("length").distinct().collect())  # at most SHINGLE + 1
    if 0 in lengths:
        raise ValueError("a template without a word")
    if not lengths:
        lengths = [SHINGLE]
    own = own.select("license", "length", F.explode(_shingles(F.col("words"), lengths)).alias("x")).where("x.run = length").select("license", "x.run", "x.shingles")
    own = own.select("license", "run", F.array_distinct("shingles").alias("template"), F.size("shingles").alias("m"), _bands(F.col("shingles")).alias("bands"))
    # for each band the shingle that has the least value
    least = own.select("*", F.posexplode("template").alias("i", "s")).groupBy("license", "m", "run").agg(F.first("template").alias("template"), F.first("bands").alias("bands"), *[F.min_by("s", F.xxhash64("s", F.lit(k))).alias(f"s{k}") for k in range(HASHES)])
    least = least.select("license", "m", "run", "template", "bands", F.explode(F.array_distinct(F.array(*[f"s{k}" for k in range(HASHES)]))).alias("s"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), _shingles(_words(text_of()), lengths).alias("x"))
    texts = texts.select("row", "doc_id", F.inline("x"))
    hits = texts.select("*", F.posexplode("shingles").alias("at", "s")).join(_small(least), ["s", "run"])
    start = F.explode(F.array_distinct(F.transform(F.array(F.lit(0), F.lit(1)), lambda back: F.greatest(F.floor(F.col("at") / F.col("m")) - back, F.lit(0)) * F.col("m")))).alias("start")
    windows = hits.select("row", "doc_id", "license", "m", "template", "bands", start, "shingles")
    windows = windows.withColumn("window", F.slice("shingles", (F.col("start") + 1).cast("int"), 2 * F.col("m"))).drop("shingles")
    windows = windows.where(F.exists(F.arrays_zip("bands", _bands(F.col("window")).alias("own")), lambda z: z["bands"] == z["own"]))
    share = F.size(F.array_intersect("window", "template")) / F.size("template")
    found = windows.withColumn("share", share).where(F.col("share") >= CONTAINED).withColumn("at", F.array_position("window", F.get("template", F.lit(0))))
    first = F.col("start") + F.greatest(F.col("at") - 1, F.lit(0))
    out = found.groupBy("row", "license").agg(F.first("doc_id").alias("doc_id"), F.max("share").alias("containment"), F.count_distinct("start").alias("n_windows"), F.min(first).alias("first_word"))
    return out.select("doc_id", "license", F.round("containment", 6).alias("containment"), "n_windows", F.col("first_word").cast("long"))


def _small(least: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Broadcast the templates' least shingles if they are few; else Spark joins them by a shuffle."""
    return F.broadcast(least) if least.count() <= rows else least

