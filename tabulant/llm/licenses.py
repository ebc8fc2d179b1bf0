"""License scans: Dice coefficient over word bigrams against licence templates.

A text is normalised (A-Z lower-cased, every run of other ASCII than letters and
digits one space) and cut into segments: the whole text, its paragraphs, its
lines, and windows of a template's length. A window is laid wherever one of the
``ANCHORS`` bigrams of a template that fewest templates have occurs, so a notice
inside a longer line or across lines is found too, and their number is linear in
the text. A segment with n distinct bigrams can reach Dice >= t against a template
with m only if m t / (2 - t) <= n <= m (2 - t) / t; these size bounds pick the
candidate templates, and bigrams are intersected with those alone. Everything
happens inside one projection: no shuffle, no text leaves its row.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import let

THRESHOLD = 0.85
#: Bigrams of each template at which windows are laid.
ANCHORS = 2

#: Notices and short licence texts, by licence and wording.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    (
        "MIT",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    ("BSD", "Released under the BSD License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("ISC", "Released under the ISC License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "Released under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Released under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: All that separates words: ASCII other than letters and digits; line ends stay.
SEPARATORS = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"


def _words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchors(templates, count: int = ANCHORS) -> list[tuple[str, int, int]]:
    """(bigram, words before, words after) of the windows: the bigrams in fewest templates, of these the longest."""
    texts = [_words(text) for _, text in templates]
    pairs = [[f"{a} {b}" for a, b in zip(words, words[1:])] for words in texts]
    among = Counter(x for p in pairs for x in set(p))
    out = set()
    for words, p in zip(texts, pairs):
        for x in sorted(set(p), key=lambda x: (among[x], -len(x), x))[:count]:
            out.add((x, p.index(x), len(words) - 2 - p.index(x)))
    return sorted(out)


def bounds(m: int, threshold: float) -> tuple[int, int]:
    """The numbers of bigrams a segment may have to reach the threshold against m."""
    return math.ceil(m * threshold / (2 - threshold) - 1e-9), math.floor(m * (2 - threshold) / threshold + 1e-9)


def _index(templates, threshold: float) -> list[tuple[str, list[str], int, int]]:
    return [(name, b := template_bigrams(text), *bounds(len(b), threshold)) for name, text in templates]


def _windows(whole: Column, around: list[tuple[str, int, int]]) -> Column:
    """Windows of ``whole``, which has single spaces and one at each end."""

    def at(anchor: str, places: list[tuple[int, int]]) -> Column:
        def of_parts(parts: Column) -> Column:
            every = F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1),
                lambda i: F.array(*[F.trim(F.concat_ws(" ", F.substring_index(F.get(parts, i - 1), " ", -before), F.lit(anchor), F.substring_index(F.get(parts, i), " ", after))) for before, after in places]),
            )
            return F.flatten(every)

        return F.when(F.contains(whole, F.lit(f" {anchor} ")), let(F.split(whole, re.escape(f" {anchor} "), -1), of_parts)).otherwise(F.array().cast("array<string>"))

    by: dict[str, list[tuple[int, int]]] = {}
    for anchor, before, after in around:
        by.setdefault(anchor, []).append((before, after))
    return F.concat(*[at(anchor, places) for anchor, places in by.items()])


def _segments(text: Column, around: list[tuple[str, int, int]]) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.trim(F.regexp_replace(F.regexp_replace(low, SEPARATORS, " "), " ?\n ?", "\n"))

    def cut(t: Column) -> Column:
        paragraphs = F.transform(F.split(t, "\n\n+"), lambda p: F.trim(F.translate(p, "\n", " ")))
        windows = let(F.concat(F.lit(" "), F.trim(F.regexp_replace(t, "\n+", " ")), F.lit(" ")), lambda w: F.concat(F.array(F.trim(w)), _windows(w, around)))
        return F.array_distinct(F.concat(paragraphs, F.split(t, "\n"), windows))

    return let(plain, cut)


def _hits(segment: Column, index: Column, threshold: float, least: int, most: int) -> Column:
    """Matching templates of one segment: struct(dice, license)."""

    def scored(b: Column) -> Column:
        fits = F.filter(index, lambda t: F.size(b).between(t["low"], t["high"]))
        dice = F.transform(fits, lambda t: F.struct((2.0 * F.size(F.array_intersect(b, t["bigrams"])) / (F.size(b) + t["m"])).alias("dice"), t["name"].alias("license")))
        return F.filter(dice, lambda d: d["dice"] >= threshold)

    def of_words(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
        return F.when(F.size(w) - 1 >= least, let(F.array_distinct(pairs), scored)).otherwise(F.array().cast("array<struct<dice:double,license:string>>"))

    return let(F.filter(F.split(segment, " "), lambda x: x != ""), of_words)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, license, dice, licenses, n_matches.

    ``license`` is that of the best match (ties: the first by name), ``licenses``
    all that match, joined by commas, ``n_matches`` the matching pairs of a
    distinct segment and a template. Without a match (null and empty texts too)
    they are null, null, an empty string and 0. Repeated rows are scanned alike.
    """
    listed = _index(templates, threshold)
    index = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(len(b)).alias("m"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for n, b, lo, hi in listed])
    least, most = min(x[2] for x in listed), max(x[3] for x in listed)
    hits = F.flatten(F.transform(_segments(F.col(text_col), anchors(templates)), lambda s: _hits(s, index, threshold, least, most)))

    def summary(h: Column) -> Column:
        best = F.array_min(F.transform(h, lambda x: F.struct((-x["dice"]).alias("d"), x["license"].alias("license"))))
        names = F.array_join(F.array_sort(F.array_distinct(F.transform(h, lambda x: x["license"]))), ",")
        return F.struct(best["license"].alias("license"), (-best["d"]).alias("dice"), names.alias("licenses"), F.size(h).cast("long").alias("n_matches"))

    return docs.select(F.col(id_col).alias("doc_id"), let(hits, summary).alias("_s")).select("doc_id", "_s.license", "_s.dice", "_s.licenses", "_s.n_matches")


def license_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan in DuckDB SQL, over ``documents``."""
    listed = _index(templates, threshold)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, b))}], {len(b)}, {lo}, {hi})" for n, b, lo, hi in listed)
    around = ", ".join(f"({quoted(x)}, {before}, {after})" for x, before, after in anchors(templates))
    return rf"""
WITH templates(name, bigrams, m, low, high) AS (VALUES {rows}),
anchors(anchor, before, after) AS (VALUES {around}),
t AS (SELECT row_number() OVER () AS r, doc_id,
        trim(regexp_replace(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}', ' ', 'g'), ' ?\n ?', chr(10), 'g')) AS low FROM documents),
n AS (SELECT r, ' ' || trim(regexp_replace(low, '\n+', ' ', 'g')) || ' ' AS whole FROM t),
p AS (SELECT r, anchor, before, after, string_split(whole, ' ' || anchor || ' ') AS parts FROM n JOIN anchors ON contains(whole, ' ' || anchor || ' ')),
i AS (SELECT *, unnest(range(1, len(parts))) AS i FROM p),
c AS (SELECT r, anchor, before, after, list_filter(string_split(parts[i], ' '), lambda x: x <> '') AS a, list_filter(string_split(parts[i + 1], ' '), lambda x: x <> '') AS z FROM i),
s AS (SELECT DISTINCT r, unnest(list_transform(regexp_split_to_array(low, '\n\n+'), lambda p: trim(replace(p, chr(10), ' '))) || string_split(low, chr(10))) AS seg FROM t
      UNION SELECT r, trim(whole) FROM n
      UNION SELECT r, array_to_string(a[greatest(1, len(a) - before + 1):len(a)] || string_split(anchor, ' ') || z[1:after], ' ') FROM c),
w AS (SELECT r, list_filter(string_split(seg, ' '), lambda x: x <> '') AS words FROM s),
b AS (SELECT r, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigrams FROM w WHERE len(words) - 1 >= {min(x[2] for x in listed)}),
h AS (SELECT r, name AS license, 2.0::DOUBLE * len(list_intersect(b.bigrams, x.bigrams)) / (len(b.bigrams) + m) AS dice
      FROM b JOIN templates x ON len(b.bigrams) BETWEEN low AND high),
g AS (SELECT r, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n_matches
      FROM h WHERE dice >= {threshold} GROUP BY r)
SELECT doc_id, license, dice, coalesce(licenses, '') AS licenses, coalesce(n_matches, 0) AS n_matches FROM t LEFT JOIN g USING (r)
"""
