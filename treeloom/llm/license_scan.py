"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts become shingles of five words (lower-cased in A-Z, punctuation dropped). Two kinds of
windows are looked up:

* a template of fewer than ``LONG`` shingles is found by single shingles;
* a longer one by windows of eight shingles, four apart, each with ``BANDS`` MinHash values of
  one row. Template windows start at every shingle, so an unchanged passage of eleven shingles
  holds a window equal to a template window, which collides for certain; at a similarity of
  0.8 a window collides with probability 1 - 0.2^4 = 0.998, at 0.5 with 0.94.

Each collision gives a template and a place. The text around the place is compared with the
template exactly: a match holds at least ``CONTAINED`` of the template's distinct shingles.
All of it is DataFrame functions.

Null, empty and short texts match nothing; so do templates of fewer than five words. Rows that
repeat a document keep a result each. Templates that repeat with the same name count once. Empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import NON_WORDS, ascii_lower, small, stored, table, where_found, words

SHINGLE = 5
LONG = 12
BLOCK = 4
BANDS = 4
CONTAINED = 0.8

# Statements and notices as licenses word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "Zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
        "it and redistribute it freely, subject to the following restrictions: The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed "
        "or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
]


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def folder_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Templates of one's own, whole license texts for instance: a text file each, named by its
    license (``MIT.txt``)."""
    read = spark.read.text(folder, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return read.select(name.alias("license"), F.col("value").alias("text"))


def _shingles(df: DataFrame, text_col: str) -> DataFrame:
    """Add shingles_, the hash of every run of five words in order."""
    w = F.col("words_")
    n = F.size(w) - SHINGLE
    runs = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    cut = df.withColumn("words_", words(ascii_lower(F.col(text_col)), NON_WORDS))
    return cut.withColumn("shingles_", F.when(n >= 0, runs).otherwise(F.array().cast("array<bigint>"))).drop("words_")


def _key(band: int, least: Column) -> Column:
    return F.xxhash64(F.lit(band), least)


def _least(shingles: Column, first: Column | int, width: int, band: int) -> Column:
    """The MinHash value of a band over ``width`` shingles from position ``first`` (from 1)."""
    return F.array_min(F.transform(F.slice(shingles, first, width), lambda h: _key(band, h)))


def text_windows(df: DataFrame) -> DataFrame:
    """Replace shingles_ by key and place: every shingle by itself, and the bands of every
    window of two blocks. A block's MinHash is computed once for the two windows it is in."""
    s = F.col("shingles_")
    rest = [c for c in df.columns if c != "shingles_"]
    count = F.floor(F.size(s) / BLOCK).cast("int")
    none = F.array().cast("array<bigint>")

    def blocks(band: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), count - 1), lambda j: _least(s, j * BLOCK + 1, BLOCK, band))
        return F.when(count >= 2, each).otherwise(none)

    def windows(band: int) -> Column:
        m = F.col(f"band{band}_")
        ends = F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))
        key = lambda h, j: _key(band, F.least(F.get(m, j), h)).alias("key")
        return F.transform(ends, lambda h, j: F.struct(key(h, j), (j * BLOCK).alias("place")))

    banded = df.withColumns({f"band{b}_": blocks(b) for b in range(BANDS)})
    singles = F.transform(s, lambda h, i: F.struct(h.alias("key"), i.alias("place")))
    parts = [singles, *[windows(b) for b in range(BANDS)]]
    every = F.concat(*[p.cast("array<struct<key:bigint,place:int>>") for p in parts])
    # An inner explode would be given a filter on its size, which works all windows out twice.
    return banded.select(*rest, F.explode_outer(every).alias("at_")).select(*rest, "at_.key", "at_.place")


def template_windows(templates: DataFrame) -> DataFrame:
    """key, place, template: where each template can be met."""
    s = F.col("shingles_")
    width = 2 * BLOCK
    whole = templates.select("template", "shingles_")
    single = whole.filter(F.size(s) < LONG).select("template", F.posexplode(s).alias("place", "key"))
    long = whole.filter(F.size(s) >= LONG).select("template", "shingles_", F.explode(F.sequence(F.lit(0), F.size(s) - width)).alias("place"))
    out = single.select("key", "place", "template")
    for b in range(BANDS):
        key = _key(b, _least(s, F.col("place") + 1, width, b))
        out = out.unionByName(long.select(key.alias("key"), "place", "template"))
    return out.distinct()


def license_matches(docs: DataFrame, templates: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, contained (share of the template's distinct shingles), first_word (of
    the best place, the earliest of equals) for each row of ``docs`` and template found in it."""
    named = _shingles(templates.select("license", "text"), "text").filter(F.size("shingles_") > 0)
    known = stored(named.select("license", "shingles_", F.xxhash64("license", "shingles_").alias("template")).distinct(), "templates")
    found = stored(template_windows(known), "template-windows")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key_"), "text")
    met = text_windows(_shingles(keyed, "text").drop("text")).join(small(found.withColumnRenamed("place", "at")), "key")
    places = met.groupBy("doc_id", "key_", "template").agg(F.collect_set(F.col("place") - F.col("at")).alias("starts"))
    width = F.size("shingles_") * 8
    listed = places.join(small(known, width), "template").groupBy(F.col("doc_id").alias("doc_"), F.col("key_").alias("other_")).agg(
        F.collect_list(F.struct("license", "starts", F.col("shingles_").alias("shingles"))).alias("near_")
    )
    listed = stored(listed, "places")
    bytes_ = F.aggregate("near_", F.lit(0), lambda acc, c: acc + 8 * F.size(c["starts"]) + 8 * F.size(c["shingles"]))
    same = keyed["doc_id"].eqNullSafe(F.col("doc_")) & (keyed["key_"] == F.col("other_"))
    beside = _shingles(keyed.join(small(listed, bytes_), same).select("doc_id", "text", "near_"), "text")
    each = beside.select("doc_id", "shingles_", F.explode("near_").alias("c")).select("doc_id", "shingles_", "c.*")
    own = each.withColumn("own_", F.array_distinct("shingles")).withColumn("n_", F.size("shingles"))
    slack = F.ceil(F.col("n_") / 4).cast("int")

    def at(start: Column) -> Column:
        first = F.greatest(start - slack, F.lit(0))
        near = F.slice("shingles_", first + 1, F.greatest(start - first + F.col("n_") + slack, F.lit(0)))
        share = F.size(F.array_intersect("own_", near)) / F.size("own_")
        # The greatest share first, of equal ones the earliest start.
        return F.struct(share.alias("contained"), (-F.greatest(start, F.lit(0))).alias("back"))

    best = own.select("doc_id", "license", F.array_max(F.transform("starts", at)).alias("best"))
    return where_found(best.withColumn("found_", F.col("best.contained") >= contained), "found_").select(
        "doc_id", "license", F.col("best.contained").alias("contained"), (-F.col("best.back")).cast("bigint").alias("first_word")
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"), default_templates(spark))
