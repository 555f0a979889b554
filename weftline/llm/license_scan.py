"""License scan by MinHash bands over overlapping text windows (DataFrame operations only).

Texts are sequences of five-word shingles (words as in tokens). Windows of four shingles begin
at every second shingle; templates of fewer than WINDOW + 1 shingles are met by windows of one.
Each of the HASHES minima of a window is a band of its own. A passage that holds a template
word for word holds windows that equal template windows (those are taken at every offset), so
its bands collide for certain; a window at Jaccard similarity J collides with probability
1 - (1 - J) ** HASHES, that is 0.96 at J = 2/3, and the windows of a passage are many. Templates
retrieved in this way are verified: the share of their shingles found in the text is exact.

The templates are the stated query set; all work is done row by row, without a shuffle. Cases:
null and empty texts, and texts of fewer than five words, match nothing; templates of fewer
than five words are rejected; rows that repeat a doc_id are scanned each for itself; a null id stays
null; texts of any length are scanned whole; templates that tie are all returned; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import computed_once

K, WINDOW, STRIDE, HASHES, THRESHOLD = 5, 4, 2, 3, 0.8
SEEDS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B)
SINGLE = 0x2545F4914F6CDD1D

# Customary wordings of license notices.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def word_hashes(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: str) -> Column:
    """From the column of word hashes."""
    each = F.transform(F.sequence(F.lit(0), F.size(hashes) - K), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(K)]))
    return F.when(F.size(hashes) >= K, each).otherwise(F.array().cast("array<bigint>"))


def _minimum(column: str, seed: int) -> Callable[[Column], Column]:
    return lambda i: F.least(*[F.get(column, i + j).bitwiseXOR(F.lit(_signed(seed))) for j in range(WINDOW)])


def bands(column: str, stride: int, single: bool, windows: bool) -> Column:
    """The band values of all windows of the shingle column."""
    parts = []
    if single:
        parts.append(F.transform(column, lambda h: h.bitwiseXOR(F.lit(_signed(SINGLE)))))
    if windows:
        starts = F.when(F.size(column) >= WINDOW, F.sequence(F.lit(0), F.size(column) - WINDOW, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        parts += [F.transform(starts, _minimum(column, seed)) for seed in SEEDS[:HASHES]]
    return F.concat(*parts)


def compiled(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[int], list[int]]]:
    """(name, distinct shingles, bands) of each template."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    rows = rows.withColumn("w", word_hashes(F.col("text"))).withColumn("h", shingles("w"))
    short = F.size("h") <= WINDOW
    found = rows.select("name", F.array_distinct("h"), F.array_distinct(F.when(short, bands("h", 1, True, False)).otherwise(bands("h", 1, False, True)))).collect()
    for name, h, _ in found:
        if not h:
            raise ValueError(f"template {name} has fewer than {K} words")
    return [tuple(r) for r in found]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and template found: doc_id, license, containment, first_word, last_word (0-based places of its shingles)."""
    known = compiled(docs.sparkSession, TEMPLATES if templates is None else templates)
    longs = lambda x: F.array(*[F.lit(v).cast("bigint") for v in x])
    rows = docs.select(F.col(id_col).alias("doc_id"), computed_once("w", word_hashes(F.col(text_col))))
    rows = rows.select("doc_id", computed_once("h", shingles("w"))).select("doc_id", "h", computed_once("sig", bands("h", STRIDE, True, True)))
    rows = rows.filter(F.arrays_overlap("sig", longs(sorted({b for _, _, bs in known for b in bs}))))
    hits = [F.when(F.arrays_overlap("sig", longs(bs)), F.struct(F.lit(name).alias("license"), longs(h).alias("t"))) for name, h, bs in known]
    rows = rows.select("doc_id", "h", F.explode(F.array_compact(F.array(*hits))).alias("c"))
    rows = rows.select("doc_id", "h", "c.license", F.size("c.t").alias("n"), computed_once("both", F.array_intersect("c.t", "h")))
    rows = rows.withColumn("containment", F.size("both") / F.col("n")).filter(F.col("containment") >= threshold)
    places = F.transform("both", lambda s: F.array_position("h", s) - 1)
    return rows.select("doc_id", "license", "containment", F.array_min(places).alias("first_word"), (F.array_max(places) + K - 1).alias("last_word"))


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL: exact containment of every template in every document."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(templates.items()))
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH tw AS (SELECT name, {words("text")} AS ws FROM (VALUES {values}) v(name, text)),
ts AS (SELECT DISTINCT name, list_slice(ws, i, i + 4) AS s FROM (SELECT name, ws, unnest(range(1, len(ws) - 3)) AS i FROM tw)),
tn AS (SELECT name, count(*) AS n FROM ts GROUP BY name),
dw AS (SELECT doc_id, {words("text")} AS ws FROM documents),
ds AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM dw WHERE len(ws) >= 5)),
hit AS (SELECT doc_id, name, s, min(i) AS i FROM ds JOIN ts USING (s) GROUP BY doc_id, name, s)
SELECT doc_id, name AS license, count(*) / n AS containment, min(i) - 1 AS first_word, max(i) + 3 AS last_word
FROM hit JOIN tn USING (name) GROUP BY doc_id, name, n HAVING count(*) / n >= {threshold}"""
