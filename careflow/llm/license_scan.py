"""License scan with MinHash bands over overlapping text windows (operator 6, DataFrame functions only).

Templates are license notices and whole license texts; each falls in a window class by its length: windows of W words
every W / 4 words, so that a template of up to 3W/4 + 1 words lies whole in a window; W doubles as far as needed. A window's and a template's 3-word shingles get
BANDS MinHash values, one row a band: with Jaccard similarity s they collide in some band with probability
1 - (1 - s)^BANDS. A notice that is whole in a window of its class has s >= 1/6, and mostly s >= 1/2: missed with
probability under 2e-4 and under 6e-8. Windows that share a band value with a template of their class are verified:
the share of the template's distinct shingles that the window holds must be MIN_CONTAINMENT or more.

A window can share a band value only if it holds the shingle that gives the template's minimum. These few shingles
are looked for first in each text, and only windows around them get MinHash values; no other window can collide, so
the result is that of hashing every window of every text.

Defined results: null texts and texts without words give no rows; a text shorter than a window is one window;
notices of fewer than three words are never matched; repeated rows are reported each (as one row if they share
doc_id and text); an empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm.common import row_key, staged, table

SHINGLE, BANDS, MIN_CONTAINMENT = 3, 24, 0.85
CLASSES = tuple(1 << k for k in range(3, 31))
#: Templates (rows) up to which their values are built into one plan; more are scanned for in several passes.
MAX_TEMPLATES = 2_000
BLANKS = r"[\x20\x09-\x0D]+"
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'’‘“”«»©"

#: Public license notices (fixed values).
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("All-rights-reserved", "All rights reserved."),
    ("AGPL", "GNU Affero General Public License"),
    ("LGPL-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
     "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
     "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
     "DEALINGS IN THE SOFTWARE."),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
     "all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
     "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
     "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-3-Clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
     "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
     "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
     "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
     "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
     "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF "
     "SUCH DAMAGE."),
]


def words_of(text: Column) -> Column:
    """Words in lower case without punctuation (a mark inside a word goes too: `by-nc` is one word `bync`)."""
    line = F.trim(F.regexp_replace(F.translate(F.lower(text), PUNCTUATION, ""), BLANKS, " "))
    return F.when(line != "", F.split(line, " "))


def shingle_hashes(words: str) -> Column:
    """Hash of each SHINGLE words of an array column (empty if it is shorter)."""
    starts = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))


def min_hashes(hashes: Column) -> Column:
    """BANDS MinHash values of an array of shingle hashes."""
    band = lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k))))
    return F.array(*(band(k) for k in range(BANDS)))


def template_table(templates: DataFrame) -> DataFrame:
    """(license, window, hashes, size, bands) of the templates (license, text) that have a shingle and a class."""
    words = templates.select("license", words_of(F.col("text")).alias("words"))
    window = F.lit(None).cast("int")
    for w in reversed(CLASSES):
        window = F.when(F.size("words") <= 3 * w // 4 + 1, F.lit(w)).otherwise(window)
    hashed = words.select("license", window.alias("window"), F.array_distinct(shingle_hashes("words")).alias("hashes"))
    return hashed.filter((F.size("hashes") > 0) & F.col("window").isNotNull()).withColumns({"size": F.size("hashes"), "bands": min_hashes(F.col("hashes"))})


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, license, windows, first_word, containment): per text and license, the verified windows, where the
    first of them starts (from 0), and the best containment. row is the hash of the text."""
    known = staged(template_table(templates), "templates")
    passes = 1 if (many := known.count()) <= MAX_TEMPLATES else 2 * math.ceil(many / MAX_TEMPLATES)
    parts = [known.filter(F.pmod(F.xxhash64("license"), F.lit(passes)) == i) for i in range(passes)]
    return reduce(DataFrame.unionByName, [_scan(docs, part, id_col, text_col) for part in parts])


def _scan(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # the shingles that give a template's minimum in some band, by window class; at most BANDS for each template
    lowest = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, k).alias("m"), h.alias("h"))))["h"])
    seeds = known.select("window", F.explode(lowest).alias("h")).distinct()
    by_class = {r["window"]: r["hs"] for r in seeds.groupBy("window").agg(F.collect_list("h").alias("hs")).collect()}
    bands = known.select("license", "window", F.posexplode("bands").alias("band", "value")).distinct()

    words = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), row_key(text_col).alias("row"), F.explode(F.array(words_of(F.col(text_col)))).alias("words"))
    shingled = words.select("doc", "row", F.size("words").alias("n"), F.explode(F.array(shingle_hashes("words"))).alias("sh"))
    places = lambda hs: F.filter(F.transform("sh", lambda h, i: F.when(h.isin(hs), i)), lambda i: i.isNotNull())

    def starts(window: int, hs: list[int]) -> Column:
        """Windows (multiples of the step, from 0) that hold the shingle at place p whole."""
        step = window // 4
        last = F.ceil(F.greatest(F.col("n") - window, F.lit(0)) / step).cast("int")  # the last window reaches the end
        first_of = lambda p: F.greatest(F.ceil((p + SHINGLE - window) / step).cast("int"), F.lit(0))
        around = lambda p: F.sequence(first_of(p), F.greatest(first_of(p), F.least(F.floor(p / step).cast("int"), last)))
        return F.transform(F.array_distinct(F.flatten(F.transform(places(hs), around))), lambda k: F.struct(F.lit(window).alias("window"), (k * step).alias("start")))

    if not by_class:
        return words.limit(0).select("doc", "row", F.lit("").alias("license"), F.lit(0).cast("long").alias("windows"), F.lit(0).alias("first_word"), F.lit(0.0).alias("containment"))
    found = shingled.withColumn("at", F.explode(F.array(F.concat(*(starts(w, hs) for w, hs in sorted(by_class.items()))))))
    hit = found.filter(F.size("at") > 0).select("doc", "row", "sh", F.explode("at").alias("w"))
    windows = staged(
        hit.select("doc", "row", "w.window", "w.start", F.array_distinct(F.slice("sh", F.col("w.start") + 1, F.col("w.window") - (SHINGLE - 1))).alias("held")).filter(F.size("held") > 0), "windows"
    )
    signed = windows.select("doc", "row", "window", "start", F.posexplode(min_hashes(F.col("held"))).alias("band", "value"))
    pairs = signed.join(F.broadcast(bands), ["window", "band", "value"]).select("doc", "row", "window", "start", "license").distinct()
    again = pairs.select("license", *(F.col(c).alias(f"_{c}") for c in ("doc", "row", "window", "start")))
    place = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")) & (F.col("window") == F.col("_window")) & (F.col("start") == F.col("_start"))
    checked = windows.join(again, place).drop("_doc", "_row", "_window", "_start").join(F.broadcast(known.select("license", "window", "hashes", "size")), ["license", "window"])
    checked = checked.withColumn("containment", F.size(F.array_intersect("held", "hashes")) / F.col("size")).filter(F.col("containment") >= MIN_CONTAINMENT)
    return checked.groupBy("doc", "row", "license").agg(F.countDistinct("window", "start").alias("windows"), F.min("start").alias("first_word"), F.max("containment").alias("containment"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"), spark.createDataFrame(NOTICES, "license string, text string"))
    return found.select(F.col("doc").alias("doc_id"), "license", "windows", F.col("first_word").cast("long").alias("first_word"), F.round("containment", 6).alias("containment"))


def _sql_words(text: str) -> str:
    p = PUNCTUATION.replace("'", "''")
    return f"string_split(trim(regexp_replace(translate(lower({text}), '{p}', ''), '{BLANKS}', ' ', 'g')), ' ')"


_QUOTED = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in NOTICES)
_CLASS = "CASE " + " ".join(f"WHEN len(ws) <= {3 * w // 4 + 1} THEN {w}" for w in CLASSES) + " END"
_SHINGLES = f"list_distinct(list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i+{SHINGLE - 1}], ' ')))"
#: Containment over every window on the grid: what a MinHash without misses would report.
ORACLE_SQL = f"""
WITH t AS (SELECT license, {_CLASS} AS w, {_SHINGLES} AS ss FROM (SELECT license, {_sql_words("text")} AS ws FROM (VALUES {_QUOTED}) v(license, text)) WHERE len(ws) >= {SHINGLE}),
ts AS (SELECT license, w, len(ss) AS size, unnest(ss) AS s FROM t),
d AS (SELECT doc_id, {_sql_words("text")} AS ws FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i, unnest(list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i+{SHINGLE - 1}], ' '))) AS s FROM d),
h AS (SELECT doc_id, n, license, w, size, s, i - 1 AS p FROM p JOIN ts USING (s)),
g AS (SELECT doc_id, license, w, size, s, unnest(range(greatest(0, ceil((p + {SHINGLE} - w) / (w / 4.0))::BIGINT), 1 + least((p // (w // 4)), ceil(greatest(n - w, 0) / (w / 4.0))::BIGINT))) AS k FROM h),
c AS (SELECT doc_id, license, w, k, count(DISTINCT s) / size AS containment FROM g GROUP BY doc_id, license, w, k, size)
SELECT doc_id, license, count(*) AS windows, min(k * (w // 4))::BIGINT AS first_word, round(max(containment), 6) AS containment
FROM c WHERE containment >= {MIN_CONTAINMENT} GROUP BY doc_id, license
"""
