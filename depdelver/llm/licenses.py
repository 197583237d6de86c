"""License scans: Dice coefficient over word bigrams, in DataFrame functions only."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depdelver.session import cut

#: Similarity from which a text counts as a template, in hundredths.
PERCENT = 75
#: Share of a line's bigrams that are a template's, from which the line counts as a piece of it, in hundredths.
LINE_PERCENT = 50
#: Bytes of templates that are sent to every executor.
BROADCAST_BYTES = 32 << 20
#: Bits of the maps by which lines are passed over: a line costs the same, however many templates there are.
BITS = 1 << 20
#: Telling words up to which they are looked up in each unit.
FEW = 500

# Fixed values: notices and license texts, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n"
        "http://www.apache.org/licenses/LICENSE-2.0\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n"
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]
# End of fixed values.

WORD = r"[a-z0-9]+"
SENTENCE = r"[.!?][ \t\r\f]+"


def normal_words(text: str) -> list[str]:
    """Runs of a-z and digits after lower-casing A-Z; the rule for templates and texts alike."""
    return re.findall(WORD, re.sub(r"[A-Z]+", lambda m: m[0].lower(), text))


def bigrams(words: list[str]) -> set[str]:
    """Pairs of neighbours, or the word itself if there is only one."""
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words)


def _table(templates: list[tuple[str, str]]) -> list[tuple[str, int, list[str]]]:
    """(license, number, bigrams) of every template, and of its paragraphs if it has several."""
    out = []
    for k, (name, text) in enumerate(templates):
        for part in dict.fromkeys([text, *text.split("\n")]):
            if b := bigrams(normal_words(part)):
                out.append((name, k, sorted(b)))
    return out


def full_texts(folder: str) -> list[tuple[str, str]]:
    """A template of each file in ``folder``: its name and its whole text, as one paragraph."""
    files = sorted(f for f in Path(folder).iterdir() if f.is_file())
    return [(f.name, " ".join(f.read_text(encoding="utf-8", errors="replace").split())) for f in files]


def telling_words(table: list[tuple[str, int, list[str]]], percent: int) -> list[str]:
    """Words of which a text that reaches ``percent`` against any template has one at least.

    With a Dice coefficient of d, the text has d / (2 - d) of a template's bigrams at least, so
    of any larger share than the rest it has one, and with it each of that bigram's words. The
    bigrams with the longest words are taken.
    """
    found: set[str] = set()
    for _, _, grams in table:
        need = -(-percent * len(grams) // (200 - percent))  # bigrams that the text must have
        long_ = sorted(grams, key=lambda g: (-max(map(len, g.split())), g))
        found |= {max(g.split(), key=lambda w: (len(w), w)) for g in long_[: len(grams) - need + 1]}
    return sorted(found)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({WORD})"), F.lit(1))


def _pairs(w: Column) -> Column:
    n = F.size(w)
    return F.array_distinct(F.when(n > 1, F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(w))


def bitmap(terms: set[str]) -> Column:
    """Bits by the crc32 of some terms, in longs; its size does not depend on the terms."""
    words = [0] * (BITS // 64)
    for t in terms:
        h = zlib.crc32(t.encode()) % BITS
        words[h // 64] |= 1 << h % 64
    return F.split(F.lit(" ".join(str(w - (1 << 64) if w >> 63 else w) for w in words)), " ").cast("array<long>")


def maybe(bits: Column, term: Column) -> Column:
    """Whether a term may be one of a bitmap's: never false for one that is."""
    h = F.crc32(term) % BITS
    return F.getbit(F.element_at(bits, (F.floor(h / 64) + 1).cast("int")), (h % 64).cast("int")) == 1


def _wrapped(rows: DataFrame, owners: DataFrame, known: Column, tells: Callable[[str], Column], line_percent: int) -> DataFrame:
    """Words of each run of lines that are pieces of one template: doc_id, w.

    Lines that have too few of the bigrams of any template, by the bitmap ``known``, go at once; what is
    left is joined to the templates by bigram and shuffled by row and template.
    """
    rows = rows.select("doc_id", "t", F.monotonically_increasing_id().alias("row"))  # no key of the documents tells their rows apart
    words = F.filter(F.transform(F.split("t", "\n"), _words), lambda x: F.size(x) > 0)
    lines = rows.select("doc_id", "row", F.posexplode(words).alias("place", "w"))
    lines = lines.select("*", F.explode(F.array(_pairs(F.col("w")))).alias("b"))
    lines = lines.where(100 * F.size(F.filter("b", lambda g: maybe(known, g))) >= line_percent * F.size("b"))
    met = lines.select("doc_id", "row", "place", "w", F.size("b").alias("k"), F.explode("b").alias("gram")).join(owners, "gram")
    pieces = met.groupBy("row", "i", "place").agg(F.first("doc_id").alias("doc_id"), F.first("w").alias("w"), F.first("k").alias("k"), F.count("*").alias("n"))
    pieces = pieces.where(100 * F.col("n") >= line_percent * F.col("k"))
    order = Window.partitionBy("row", "i").orderBy("place")
    starts = pieces.withColumn("starts", F.coalesce(F.col("place") - F.lag("place").over(order) > 2, F.lit(True)).cast("int"))
    runs = starts.withColumn("run", F.sum("starts").over(order)).groupBy("row", "i", "run")
    found = runs.agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("place", "w"))).alias("x")).where(F.size("x") > 1)
    return found.select("doc_id", F.flatten("x.w").alias("w")).where(tells("w"))


def scan(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT, line_percent: int = LINE_PERCENT
) -> DataFrame:
    """Every place that matches a license: doc_id, license, template, shared, size, template_size, unit.

    A text's units are itself, its lines, the sentences of a line (cut after . ! or ? and
    white space), and the pieces of a template in lines that follow each other, as a notice is
    wrapped in a longer text: lines of which ``line_percent`` / 100 of the set, as below, are in
    the template's, two at least; lines without words are left out, and one other line between
    two pieces is passed over. A unit's words are its runs of a-z and digits, A-Z lower-cased, and its set
    the pairs of neighbouring words (or its only word). Templates and their paragraphs are made
    the same way. Of the templates whose size can reach the Dice coefficient ``percent`` / 100
    with the unit's, the most similar one is returned if it does, ties to the first: its number,
    the bigrams shared and those of each side; ``unit`` is the unit's normalised text. Units
    of a document id with the same words are one. Null and empty texts, and those without words,
    give none; null and repeated ids are kept; other columns are not read; an empty table gives
    no rows.

    Texts without any of the words that a match must have are left out by one look at their
    words, and so are units, by these or a bitmap of them. The others are written as a table and meet the templates, a fixed list, by size; only
    matches, and lines that may be pieces, are shuffled.
    """
    table = _table(templates)
    spark = docs.sparkSession
    tell = telling_words(table, percent)
    telling, told = F.split(F.lit(" ".join(tell)), " "), bitmap(set(tell))
    # Few words are looked up in a unit's; of many, the unit's are looked up in the bitmap.
    tells = lambda w: F.arrays_overlap(w, telling) if len(tell) <= FEW else F.exists(w, lambda x: maybe(told, x))  # noqa: E731
    # The sizes of a text that can reach each template: Dice is at most 2 * smaller / both.
    sized = [(k, -i) for i, (_, _, own) in enumerate(table) for k in range(-(-percent * len(own) // (200 - percent)), (200 - percent) * len(own) // percent + 1)]
    grams = [(-i, name, number, len(own), own) for i, (name, number, own) in enumerate(table)]
    # Templates are an argument, held by the caller; beyond this size they are joined by a shuffle.
    small = 16 * len(sized) + sum(len(g) + 16 for _, _, own in table for g in own) <= BROADCAST_BYTES
    sent = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema)) if small else spark.createDataFrame(rows, schema)  # noqa: E731
    sized = sent(sized, "k int, i int")
    owners = sent([(i, g) for i, _, _, _, own in grams for g in own], "i int, gram string")
    known = bitmap({g for _, _, own in table for g in own})
    grams = sent(grams, "i int, license string, template int, template_size int, grams array<string>")
    t = F.col("t")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    rows = cut(rows.where(F.arrays_overlap(_words(t), telling)))  # read twice; the texts' words are made once
    lines = F.split(t, "\n")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE)))
    units = rows.select("doc_id", F.explode(F.array_distinct(F.concat(F.array(t), lines, sentences))).alias("u"))
    # Exploding once more keeps the words from being made again wherever they are used.
    words = units.select("doc_id", F.explode(F.array(_words(F.col("u")))).alias("w")).where(tells("w"))
    words = words.unionByName(_wrapped(rows, owners, known, tells, line_percent))
    sets = words.select("doc_id", "w", F.explode(F.array(_pairs(F.col("w")))).alias("b")).withColumn("k", F.size("b"))
    met = sets.join(sized, "k").join(grams, "i").withColumn("shared", F.size(F.array_intersect("b", "grams")))
    met = met.where(200 * F.col("shared") >= percent * (F.col("k") + F.col("template_size")))
    score = 200 * F.col("shared") / (F.col("k") + F.col("template_size"))
    met = met.select("doc_id", F.array_join("w", " ").alias("unit"), F.struct(score.alias("d"), "i", "license", "template", "shared", F.col("k").alias("size"), "template_size").alias("x"))
    best = met.groupBy("doc_id", "unit").agg(F.max("x").alias("x"))
    return best.select("doc_id", "x.license", "x.template", "x.shared", "x.size", "x.template_size", "unit")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_ROWS = ", ".join(f"({i}, '{n}', {k}, [{', '.join(chr(39) + g + chr(39) for g in b)}])" for i, (n, k, b) in enumerate(_table(TEMPLATES)))

SQL = rf"""
WITH t(i, license, template, grams) AS (VALUES {_ROWS}),
d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lw AS (
  SELECT r, doc_id, list_filter(list_transform(l, lambda x: regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')), lambda x: len(x) > 0) AS lw FROM d
), lp AS (SELECT r, doc_id, unnest(lw) AS w, generate_subscripts(lw, 1) AS place FROM lw),
lb AS (SELECT *, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) ELSE w END) AS b FROM lp),
lg AS (SELECT r, place, unnest(b) AS gram FROM lb),
tg AS (SELECT i, unnest(grams) AS gram FROM t),
hit AS (SELECT r, i, place, count(*) AS n FROM lg JOIN tg USING (gram) GROUP BY r, i, place),
piece AS (SELECT r, i, place, doc_id, w FROM hit JOIN lb USING (r, place) WHERE 100 * n >= 50 * len(b)),
begun AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY r, i ORDER BY place) <= 2 THEN 0 ELSE 1 END AS begins FROM piece),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY r, i ORDER BY place) AS run FROM begun),
wrapped AS (SELECT doc_id, flatten(list(w ORDER BY place)) AS w FROM numbered GROUP BY r, i, run, doc_id HAVING count(*) > 1),
u AS (SELECT doc_id, unnest(list_distinct([text] || l || flatten(list_transform(l, lambda x: string_split_regex(x, '[.!?][ 	
]+'))))) AS u FROM d),
w AS (
  SELECT doc_id, regexp_extract_all(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM u
  UNION ALL SELECT doc_id, w FROM wrapped
),
s AS (
  SELECT doc_id, array_to_string(w, ' ') AS unit,
         list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) ELSE w END) AS b
  FROM w WHERE len(w) > 0
), m AS (
  SELECT s.doc_id, s.unit, t.i, t.license, t.template, len(list_intersect(s.b, t.grams)) AS shared, len(s.b) AS size, len(t.grams) AS template_size
  FROM s JOIN t ON 200 * least(len(s.b), len(t.grams)) >= 75 * (len(s.b) + len(t.grams))
)
SELECT doc_id, license, CAST(template AS INTEGER) AS template, CAST(shared AS INTEGER) AS shared, CAST(size AS INTEGER) AS size, CAST(template_size AS INTEGER) AS template_size, unit
FROM m WHERE 200 * shared >= 75 * (size + template_size)
QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY 200.0 * shared / (size + template_size) DESC, i) = 1
"""
