"""Licence scans with DataFrame functions only.

Units of a document are its lines and its blocks (text between blank lines, for notices that wrap). A unit is lower-cased, all but
``a-z0-9`` becomes a space, and its set of word bigrams is compared with each template's by Dice's coefficient
``2 |A n B| / (|A| + |B|)``. A coefficient of at least ``t`` needs ``t / (2 - t) <= |A| / |B| <= (2 - t) / t``, so units outside the
templates' size bounds are dropped first and every template is held only against units of its sizes. A unit of w words, d of
them distinct, has at most w - 1 and at least d - 1 bigrams, so most units go before any bigram is made. Licence texts stand
as their paragraphs. The scan is row by row: no shuffle, no Python.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Licence notices and paragraphs of licence texts by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def template_bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def _words(unit: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def scan(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_units`` (distinct lines and blocks that match a template), ``license``
    and ``dice`` (the best match, 6 digits; ties: the identifier that sorts last).

    Null and empty texts and texts without a match have 0 units and null for the rest; units of fewer than two words never
    match; repeated rows give repeated results; extra columns are not carried; an empty table gives an empty table.
    """
    grams = [(name, template_bigrams(text)) for name, text in TEMPLATES]
    bounds = [size_bounds(len(g), threshold) for _, g in grams]
    least, most = min(b[0] for b in bounds), max(b[1] for b in bounds)
    text = F.coalesce(df[text_col], F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t]*\n")))
    # a set of n bigrams needs n + 1 words at least, however long the unit is
    words = F.filter(F.transform(units, _words), lambda w: (F.size(w) > least) & (F.size(F.array_distinct(w)) - 1 <= most))
    sets = F.filter(F.transform(words, _bigrams), lambda g: F.size(g).between(least, most))

    def best(unit: Column) -> Column:
        scores = []
        for (name, own), (low, high) in zip(grams, bounds):
            both = F.size(F.array_intersect(unit, F.array(*map(F.lit, own))))
            dice = F.when(F.size(unit).between(low, high), 2 * both / (F.size(unit) + len(own)))
            scores.append(F.struct(F.round(dice, 6).alias("dice"), F.lit(name).alias("license")))
        return F.array_max(F.filter(F.array(*scores), lambda s: s["dice"] >= threshold))

    found = F.filter(F.transform(sets, best), lambda s: s.isNotNull())
    rows = df.select(df[id_col].alias("doc_id"), found.alias("found")).withColumn("top", F.array_max("found"))
    return rows.select("doc_id", F.size("found").cast("long").alias("n_units"), F.col("top.license").alias("license"), F.col("top.dice").alias("dice"))


def scan_sql(threshold: float = THRESHOLD) -> str:
    """The same scan in DuckDB SQL over the view ``documents``."""
    rows = []
    for name, text in TEMPLATES:
        grams = template_bigrams(text)
        rows.append(f"('{name}', [{', '.join(repr(g) for g in grams)}])")
    return f"""
WITH templates(license, grams) AS (VALUES {', '.join(rows)}),
units AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(coalesce(text, ''), chr(10)), regexp_split_to_array(coalesce(text, ''), '\\n[ \\t]*\\n')))) AS unit FROM documents),
split_up AS (SELECT doc_id, unit, list_filter(string_split(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS words FROM units),
sets AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM split_up WHERE len(words) >= 2),
scored AS (SELECT s.doc_id, s.unit, t.license, round(2.0 * len(list_intersect(s.grams, t.grams)) / (len(s.grams) + len(t.grams)), 6) AS dice FROM sets s, templates t WHERE len(s.grams) * {2 - threshold} + 1e-9 >= len(t.grams) * {threshold} AND len(s.grams) * {threshold} <= len(t.grams) * {2 - threshold} + 1e-9),
best AS (SELECT doc_id, unit, max({{'dice': dice, 'license': license}}) AS top FROM scored WHERE dice >= {threshold} GROUP BY doc_id, unit),
found AS (SELECT doc_id, count(*) AS n_units, max(top) AS top FROM best GROUP BY doc_id)
SELECT d.doc_id, coalesce(f.n_units, 0) AS n_units, f.top.license AS license, f.top.dice AS dice FROM documents d LEFT JOIN found f USING (doc_id)"""
