"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies.

Everything runs as DataFrame expressions. Templates are cut into segments of at most
SEGMENT word shingles. For each class m of segment sizes a document's shingles are read in
windows of 2m with a step of m, so that a segment's copy lies whole in some window, whose
similarity to it is then a quarter at least, or a fifth where a fifth of it is changed.
BANDS bands of one minwise hash each meet such a window with chance 1 - 0.8**64 or more.
A window without any template shingle cannot collide in any band and is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, checkpoint

WIDTH = 5
SEGMENT = 16
BANDS = 64
CONTAINMENT = 0.8
LITERAL_SHINGLES = 20_000
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

#: Texts of public licenses and license notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    + _WARRANTY
    + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END,
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END,
    "bsd-2": f"{_BSD_CLAUSES} {_BSD_END}",
    "bsd-3": f"{_BSD_CLAUSES} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    + _WARRANTY
    + " IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsl-1": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "agpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "lgpl-3": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body's lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column) -> Column:
    """Hashes of the word shingles of a text, A-Z lower-cased; of fewer words, one for all; without words, none."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))

    def hashed(w: Column) -> Column:
        last = F.greatest(F.size(w) - F.lit(WIDTH - 1), F.lit(1))
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, F.lit(WIDTH))))).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashed)


def bands(window: Column) -> Column:
    """For each band the minwise hash of a window of shingles."""
    return let(window, lambda w: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(w, lambda x: F.xxhash64(x, j)))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[int]]]:
    """Names and shingles of the templates, which the caller holds."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", shingles(F.col("text")).alias("grams")).collect()
    return [(r.name, list(dict.fromkeys(r.grams))) for r in rows if r.grams]


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def with_hits(rows: DataFrame, every: list[int]) -> DataFrame:
    """Rows (doc_id, tag, grams), each once, that hold a shingle of a template, with the places of those: hits.

    Up to LITERAL_SHINGLES are part of the expression; more are a table that the shingles
    are joined with.
    """
    if len(every) <= LITERAL_SHINGLES:
        touched = checkpoint(rows.where(F.exists("grams", lambda g: g.isin(every))).dropDuplicates(["doc_id", "tag"]))
        return touched.withColumn("hits", F.filter(F.transform("grams", lambda g, i: F.when(g.isin(every), i)), lambda i: i.isNotNull()))
    known = rows.sparkSession.createDataFrame([(g,) for g in every], "gram bigint")
    once = checkpoint(rows.dropDuplicates(["doc_id", "tag"]))
    met = once.select("doc_id", "tag", F.posexplode("grams").alias("place", "gram")).join(small(known, len(every)), "gram")
    met = met.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set("place")).alias("hits")).withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    return once.join(met, once["doc_id"].eqNullSafe(met["_id"]) & (once["tag"] == met["_tag"])).drop("_id", "_tag")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_licenses, licenses, best), one for each row of ``docs``.

    licenses holds, in order, the names of the templates of whose shingles the document
    has ``containment`` or more; best is the largest such share, 0 without any. Null and
    empty texts hold none. Whole texts are scanned, of any length. Null ids and repeated
    rows are scanned like others. Extra columns are ignored. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    named = template_table(spark, TEMPLATES if templates is None else templates)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tag"))
    if not named:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_licenses"), F.array().cast("array<string>").alias("licenses"), F.lit(0.0).alias("best"))
    every = sorted({g for _, grams in named for g in grams})
    segments = []
    for name, grams in named:
        step = SEGMENT // 2
        starts = range(0, max(1, len(grams) - step), step) if len(grams) > SEGMENT else [0]
        for s in starts:
            part = grams[s : s + SEGMENT]
            segments.append((name, 1 << (len(part) - 1).bit_length(), part))
    classes = sorted({m for _, m, _ in segments})
    keys = spark.createDataFrame(segments, "name string, m int, part array<bigint>").select("name", "m", F.posexplode(bands(F.col("part"))).alias("band", "key")).distinct()
    with_grams = rows.withColumn("grams", shingles(F.col("text"))).drop("text")
    placed = with_hits(with_grams, every)
    found = None
    for m in classes:
        at = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.array(F.floor(p / F.lit(m)).cast("int"), F.greatest(F.floor(p / F.lit(m)).cast("int") - 1, F.lit(0))))))
        windows = placed.select("doc_id", "tag", "grams", F.explode(at).alias("w")).select("doc_id", "tag", F.slice("grams", F.col("w") * m + 1, F.lit(2 * m)).alias("window"))
        met = windows.select("doc_id", "tag", F.lit(m).alias("m"), F.posexplode(bands(F.col("window"))).alias("band", "key"))
        found = met if found is None else found.unionByName(met)
    likely = found.join(small(keys, BANDS * len(segments)), ["m", "band", "key"]).select("doc_id", "tag", "name").distinct()
    likely = likely.withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    texts = spark.createDataFrame(named, "name string, template array<bigint>")
    checked = placed.join(likely, placed["doc_id"].eqNullSafe(likely["_id"]) & (placed["tag"] == likely["_tag"])).join(small(texts, len(every)), "name")
    share = F.size(F.array_intersect("grams", "template")) / F.size("template")
    checked = checked.select("_id", "_tag", "name", share.alias("share")).where(F.col("share") >= containment)
    per_doc = checked.groupBy("_id", "_tag").agg(F.array_sort(F.collect_set("name")).alias("licenses"), F.max("share").alias("best"))
    thin = rows.select("doc_id", "tag")
    out = thin.join(per_doc, thin["doc_id"].eqNullSafe(per_doc["_id"]) & (thin["tag"] == per_doc["_tag"]), "left")
    licenses = F.coalesce("licenses", F.array().cast("array<string>"))
    return out.select("doc_id", F.size(licenses).cast("long").alias("n_licenses"), licenses.alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("best"))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


def _sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
    return rf"""
WITH texts AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS k, coalesce("text", '') AS txt FROM documents
  UNION ALL SELECT 't', name, txt FROM (VALUES {quoted}) v(name, txt)
), w AS (
  SELECT kind, k, regexp_extract_all(translate(txt, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM texts
), g AS (
  SELECT DISTINCT kind, k, array_to_string(words[p + 1 : p + 5], ' ') AS gram
  FROM (SELECT kind, k, words, unnest(range(0, greatest(len(words) - 4, 1))) AS p FROM w WHERE len(words) > 0)
), n AS (SELECT k AS name, count(*) AS n FROM g WHERE kind = 't' GROUP BY k),
m AS (
  SELECT d.k AS doc, t.k AS name, count(*) / max(n.n) AS share
  FROM g d JOIN g t ON d.gram = t.gram AND d.kind = 'd' AND t.kind = 't' JOIN n ON n.name = t.k GROUP BY 1, 2
), kept AS (SELECT doc, count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS licenses, max(share) AS best FROM m WHERE share >= 0.8 GROUP BY doc)
SELECT d.doc_id, coalesce(kept.n_licenses, 0) AS n_licenses, coalesce(kept.licenses, '') AS licenses, CAST(coalesce(kept.best, 0) AS DOUBLE) AS best
FROM documents d LEFT JOIN kept ON CAST(d.doc_id AS VARCHAR) = kept.doc
"""


OP8_SQL = _sql()
