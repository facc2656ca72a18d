"""License scans, in DataFrame and SQL functions only.

Templates are license notices, and the whole texts of short licenses, as sets of five-word shingles. For every size of a template, a text
is cut into windows of twice that size that overlap by half, so each passage as long as the
template lies wholly in some window. A window and a template of its size meet if they agree in any
of BANDS MinHash values; a window that holds the template has a similarity of a half or more, one
that holds eight tenths of it more than a third, so they meet with a probability of at least
1 - (2/3)**BANDS. What meets is verified by exact containment of the template's shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and words of license notices and of short licenses.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_LIST = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_GPL_END = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
NOTICES = {
    "AGPL-3.0-header": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _GPL_END,
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-full-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": _BSD_LIST + _BSD_END,
    "BSD-3-Clause": _BSD_LIST + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "has waived all copyright and related or neighboring rights to this work",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-full-header": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _GPL_END,
    "GPL-header": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-header": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
}
#: Words of a shingle.
SHINGLE = 5
#: MinHash values of a window, one a band: a miss of at most 0.002.
BANDS = 16
#: Share of a template's shingles that a window must hold.
CONTAINED = 0.8
_SEEDS = [(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1) - (1 << 63) for k in range(BANDS)]


def _words(text: Column) -> Column:
    """Words of letters and digits of a lower-cased text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(text: Column) -> Column:
    """Hashes of the runs of SHINGLE words of a text in order; none for fewer words.

    The words are bound to a lambda's variable, so that they are split once for a text, however
    often the optimizer copies this expression.
    """

    def runs(words: Column) -> Column:
        starts = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(SHINGLE))))

    return F.element_at(F.transform(F.array(_words(text)), runs), 1)


def _band_keys(size: Column, window: Column) -> Column:
    """One key for each band: window size, band and least hash under the band's seed."""
    seeds = F.array(*[F.lit(s) for s in _SEEDS])
    return F.transform(seeds, lambda s: F.xxhash64(size, s, F.array_min(F.transform(window, lambda x: x.bitwiseXOR(s)))))


def template_table(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """license, size, known (distinct shingles), keys (one a band), least (their shingles)."""
    named = spark.createDataFrame(sorted(notices.items()), "license string, notice string")
    known = named.select("license", F.array_distinct(_shingles(F.col("notice"))).alias("known")).where("size(known) > 0").withColumn("size", F.size("known"))
    seeds = F.array(*[F.lit(s) for s in _SEEDS])
    least = F.transform(seeds, lambda s: F.array_min(F.transform(F.col("known"), lambda x: x.bitwiseXOR(s))).bitwiseXOR(s))
    return known.withColumn("keys", _band_keys(F.col("size"), F.col("known"))).withColumn("least", least)


def license_matches(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment and first_word of every notice found in ``docs``.

    containment is the largest share of the notice's shingles in one window, first_word the index
    of the first word of the first such window. A text that is null, empty or shorter than five
    words holds no notice. Rows that repeat a doc_id count as one document, so do rows without one;
    other columns are ignored; an empty table gives no rows. ``notices`` (name: text) is a bounded
    list, collected and broadcast; a notice of fewer than five words cannot be found.
    """
    spark = docs.sparkSession
    templates = template_table(spark, NOTICES if notices is None else notices)
    rows = templates.collect()
    if not rows:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word")).limit(0)
    sizes = sorted({r["size"] for r in rows})
    least = sorted({x for r in rows for x in r["least"]})
    keys = sorted({x for r in rows for x in r["keys"]})
    longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")  # noqa: E731  folded to one constant

    # A band can agree only in a window that holds the shingle the template's value comes from.
    hashed = docs.select(F.col("doc_id").cast("long"), _shingles(F.col("text")).alias("shingles"))
    near = hashed.where(F.arrays_overlap("shingles", longs(least)))
    sized = near.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("shingles") - F.col("size") - 1), F.col("size"))
    windows = sized.withColumn("start", F.explode(starts)).withColumn("window", F.slice("shingles", F.col("start") + 1, F.col("size") * 2)).drop("shingles")
    held = windows.where(F.arrays_overlap("window", longs(least)))
    found = held.withColumn("key", F.explode(F.filter(_band_keys(F.col("size"), F.col("window")), lambda k: F.array_contains(longs(keys), k))))
    bands = templates.select("license", F.col("size").alias("_size"), "known", F.explode("keys").alias("_key"))
    met = found.join(F.broadcast(bands), (F.col("key") == F.col("_key")) & (F.col("size") == F.col("_size")))  # BANDS rows a notice
    share = F.size(F.array_intersect("known", "window")) / F.size("known")
    matched = met.withColumn("containment", share.cast("double")).where(F.col("containment") >= CONTAINED)
    return matched.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"))
