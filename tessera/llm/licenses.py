"""License scans, in DataFrame functions only.

A template of m words is looked for in windows of 2m words at every m-th
word, so any run of m words lies whole in one window.  MinHash bands of one
row retrieve the templates of a window, by equality of (size, band, value): with BANDS bands, a window that holds
the least containment asked for collides with probability above
``collision_probability``.  Exact containment of the template's distinct
shingles in the window then verifies.  Which windows are hashed is settled by a screen
over all shingles that lets every template shingle through, and does not tell templates apart: a window
with fewer screened places than the shortest of its size needs shingles holds none.

Edge cases: null and empty texts match nothing; a template of fewer words
than a shingle is one shingle of its own length; ties between windows go to
the earliest; rows that share a doc_id, or have none, are scanned each by itself and give one row together (the best window
of any); templates that share a name count as one; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import stored
from .native import bit_table, rows_with_hits, shingles, words

BANDS, K, CONTAINMENT = 64, 5, 0.75
#: Templates that need fewer shingles have a screen of their own, which little else passes.
FEW = 4

# License statements and notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def collision_probability(m: int, containment: float = CONTAINMENT, k: int = K, bands: int = BANDS) -> float:
    """Least probability that a window with that containment of a template of m words shares a band with it."""
    own, window = max(1, m - k + 1), max(1, 2 * m - k + 1)
    held = -(-containment * own // 1)
    return 1 - (1 - held / (window + own - held)) ** bands


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def _minhashes(hashes: Column) -> Column:
    """(band, value) for each band: the least of the band's own hash of the shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))).alias("value")))


def scan_licenses(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT, k: int = K) -> DataFrame:
    """doc_id, license, containment, start_word, n_words: the best window of each license found in each document.

    templates: license, text; a small table, joined by equality on (size, band, value).
    """
    t = templates.select("license", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    t = stored(t.select("license", F.size("w").alias("m"), "w").withColumn("kk", F.least(F.col("m"), F.lit(k))))
    sizes = sorted(r[0] for r in t.select("kk").distinct().collect())  # at most k values
    found = None
    for kk in sizes:
        own = stored(t.filter(F.col("kk") == kk).select("license", "m", F.array_distinct(shingles(F.col("w"), kk)).alias("own")))
        table, bits = bit_table(own.select(F.explode("own").alias("h")), "h")
        # the sizes of the templates, with the fewest shingles that a window of each must hold
        least = own.groupBy("m").agg(F.min(F.ceil(F.size("own") * F.lit(containment) - F.lit(1e-9))).cast("int").alias("least"))
        by_size = least.orderBy("m").collect()  # a row for each size of a template
        # documents need as many screened shingles as the shortest of the longer templates, or one of a short template, by a screen of its own
        short, longer = [m for m, n in by_size if n < FEW], [n for _, n in by_size if n >= FEW]
        single = bit_table(own.filter(F.col("m").isin(short)).select(F.explode("own").alias("h")), "h") if short else None
        flagged = stored(rows_with_hits(docs, kk, table, bits, min(longer, default=1 << 30), single))
        of_size = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(n).alias("least")) for m, n in by_size))
        spots = flagged.select("rid", F.explode("hits.pos").alias("pos"), of_size.alias("sizes"))
        # a shingle at pos lies in windows pos div m and, unless it crosses the end, the one before
        spots = spots.select("rid", "pos", F.explode("sizes").alias("x")).select("rid", "pos", "x.*")
        at = F.floor(F.col("pos") / F.col("m"))
        inside = F.filter(F.array(at, at - 1), lambda i: (i >= 0) & (F.col("pos") + kk <= (i + 2) * F.col("m")))
        windows = spots.select("rid", "m", "least", F.explode(inside).alias("i")).groupBy("rid", "m", "i").agg(F.count(F.lit(1)).alias("held"), F.first("least").alias("least")).filter(F.col("held") >= F.col("least"))
        windows = windows.groupBy("rid").agg(F.collect_list(F.struct("m", "i")).alias("at"))
        windows = flagged.select("rid", "doc_id", "sh").join(windows, "rid").select("rid", "doc_id", "sh", F.explode("at").alias("x"))
        windows = windows.select("rid", "doc_id", "x.m", (F.col("x.i") * F.col("x.m")).alias("start_word"), F.slice("sh", (F.col("x.i") * F.col("x.m") + 1).cast("int"), 2 * F.col("x.m") - kk + 1).alias("in_window"))
        windows = stored(windows)
        bands = windows.select("rid", "m", "start_word", F.explode(_minhashes(F.col("in_window"))).alias("b")).select("rid", "m", "start_word", "b.*")
        keys = own.select("license", "m", F.explode(_minhashes(F.col("own"))).alias("b")).select("license", "m", "b.*")
        pairs = bands.join(keys, ["m", "band", "value"]).select("rid", "m", "start_word", "license").distinct()
        pairs = windows.join(pairs, ["rid", "m", "start_word"]).join(own, ["license", "m"])
        share = F.size(F.array_intersect("in_window", "own")) / F.size("own")
        pairs = pairs.select("doc_id", "license", share.alias("containment"), "start_word", (2 * F.col("m")).alias("n_words")).filter(F.col("containment") >= containment)
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, license string, containment double, start_word long, n_words int")
    best = F.min_by(F.struct("containment", "start_word", "n_words"), F.struct((-F.col("containment")).alias("c"), "start_word", "n_words"))
    return found.groupBy("doc_id", "license").agg(best.alias("b")).select("doc_id", "license", "b.*")


def oracle() -> str:
    """DuckDB SQL for the rows of op1: the same windows, every template tried on each."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    split = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return f"""
    WITH t AS (SELECT license, {split} AS w FROM (VALUES {rows}) v(license, text)),
    tm AS (SELECT license, len(w) AS m, list_distinct([w[i:i+{K - 1}] for i in range(1, len(w) - {K - 2})]) AS own FROM t),
    ts AS (SELECT license, m, len(own) AS n, unnest(own) AS s FROM tm),
    d AS (SELECT doc_id, {split} AS w FROM documents),
    ds AS (SELECT doc_id, unnest([{{'pos': i - 1, 's': w[i:i+{K - 1}]}} for i in range(1, len(w) - {K - 2})], recursive := true) FROM d),
    hit AS (SELECT doc_id, license, m, n, pos, ds.s AS s FROM ds JOIN ts USING (s)),
    win AS (SELECT doc_id, license, m, n, s, pos // m - o AS i, pos FROM hit, (VALUES (0), (1)) off(o)),
    sh AS (SELECT doc_id, license, m, i, count(DISTINCT s) / any_value(n)::DOUBLE AS containment
           FROM win WHERE i >= 0 AND pos + {K} <= (i + 2) * m GROUP BY ALL),
    r AS (SELECT doc_id, license, containment, i * m AS start_word, (2 * m)::INTEGER AS n_words,
                 row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, i) AS k FROM sh WHERE containment >= {CONTAINMENT})
    SELECT doc_id, license, containment, start_word, n_words FROM r WHERE k = 1"""
