"""Licence scans with DataFrame functions only.

A text's units (every line, every paragraph of several lines, the whole of several paragraphs, and passages: lines in a row
that belong to a template, wherever other text stands around them) are normalised to lower-case ASCII words and compared to licence templates by the Dice
coefficient of their sets of word bigrams. Two sets whose coefficient is t or more differ in size by a
factor of (2 - t) / t at most, so units outside all templates' bounds are left out before any
bigram is made, and pairs outside their own bounds before they are counted. The same bound asks for
t / (2 - t) of a template's bigrams, so a text without any of the words that the rest can't do
without (see anchors) holds no match. Bigrams find their templates through an inverted list of a fixed size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkflow.llm.common import stage, table

THRESHOLD = 0.8
#: Keeps rounded bounds from leaving out what just reaches the threshold.
_SLACK = 1e-9

# Wordings of public licences and of usual notices, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("ISC", "Released under the ISC License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words that are no anchors, being frequent anywhere.
COMMON = frozenset("a an and are as at be by for from if in is it not of on or other that the this to under use with work you all any 0 1 2 3 4".split())
#: Runs of lines sent to every executor at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bigrams(text: str) -> set[str]:
    words = re.findall("[0-9a-z]+", text.translate(str.maketrans(_UPPER, _LOWER)))
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def anchors(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every text holds one that reaches the threshold with a template.

    For each template: words, those in most bigrams first, until the bigrams without any of them are too few.
    """
    found = set()
    for _, text in templates:
        own = _bigrams(text)
        rest, words = own, {w for b in own for w in b.split()} - COMMON
        while len(rest) >= threshold / (2 - threshold) * len(own) - _SLACK:
            best = max(sorted(words), key=lambda w: (w in found, sum(w in b.split() for b in rest)) if any(w in b.split() for b in rest) else (False, 0))
            found.add(best)
            rest = {b for b in rest if best not in b.split()}
    return sorted(found)


def inverted(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, int, str, int]]:
    """(bigram, template, licence, size of the template's set), a row for each bigram of each template."""
    return [(b, i, licence, len(own)) for i, (licence, text) in enumerate(templates) for own in [_bigrams(text)] for b in sorted(own)]


def _units(text: Column) -> Column:
    """An array of (unit, position, body): lines, paragraphs of several lines, the whole of several paragraphs."""
    clean = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^0-9a-z\n]+", " ")
    named = lambda kind: lambda body, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("position"), body.alias("body"))
    paragraphs = F.split(clean, "\n ?\n[ \n]*")
    several = F.filter(F.transform(paragraphs, named("paragraph")), lambda u: u["body"].contains("\n"))
    whole = F.filter(F.array(F.struct(F.lit("document").alias("unit"), F.lit(0).cast("long").alias("position"), clean.alias("body"))), lambda _: F.size(paragraphs) > 1)
    return F.concat(F.transform(F.split(clean, "\n"), named("line")), several, whole)


def _lines(text: Column) -> Column:
    """An array of (position, words) of the lines with two words or more; positions count all lines."""
    clean = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^0-9a-z\n]+", " ")
    lines = F.transform(F.split(clean, "\n"), lambda body, i: F.struct(i.cast("long").alias("position"), F.filter(F.split(body, " "), lambda w: w != "").alias("words")))
    return F.filter(lines, lambda line: F.size(line["words"]) >= 2)


def _grams(words: Column) -> Column:
    size = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, size), F.slice(words, 2, size), lambda a, b: F.concat_ws(" ", a, b)))


def passages(docs: DataFrame, index: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row, unit, position, template, licence, dice: passages that reach the threshold with a template.

    A line belongs to a template that holds half of its bigrams or more; lines of one word and empty ones are passed over. A passage is
    a longest run of two such lines or more, and is compared as one text. position is that of its first line. docs: doc_id, row, text.
    Runs are kept by a key of the text, so that only texts with a run that is long enough are read again.
    """
    keyed = docs.withColumn("key", F.sha2("text", 256))
    lines = keyed.select("row", "key", F.posexplode(_lines(F.col("text"))).alias("rank", "line"))
    grams = lines.select("row", "key", "rank", _grams(F.col("line.words")).alias("grams")).select("row", "key", "rank", F.size("grams").alias("n"), F.explode("grams").alias("bigram"))
    own = grams.join(index, "bigram").groupBy("row", "key", "rank", "template").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("size").alias("size")).filter("2 * both >= n")
    counted = own.groupBy("key", "rank", "template").agg(F.first("both").alias("both"), F.first("size").alias("size"))  # copies of a text count once
    island = F.col("rank") - F.row_number().over(Window.partitionBy("key", "template").orderBy("rank"))
    runs = counted.withColumn("island", island).groupBy("key", "template", "island").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.sum("both").alias("most"), F.first("size").alias("size"))
    # A run's words can't share more than its lines do, and one bigram where two lines meet.
    enough = F.col("most") + F.col("last") - F.col("first") >= threshold / (2 - threshold) * F.col("size") - _SLACK
    long = stage(runs.filter((F.col("last") > F.col("first")) & enough).select("key", "template", "first", "last"))
    few = long.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = keyed.join(F.broadcast(long) if few else long, "key")
    chosen = found.select("doc_id", "row", "template", F.slice(_lines(F.col("text")), F.col("first") + 1, F.col("last") - F.col("first") + 1).alias("lines"))
    sets = chosen.select("doc_id", "row", "template", F.col("lines")[0]["position"].alias("position"), _grams(F.flatten("lines.words")).alias("grams"))
    sized = sets.select("doc_id", "row", "template", "position", F.size("grams").alias("n"), F.explode("grams").alias("bigram")).join(index, ["bigram", "template"])
    both = sized.groupBy("row", "doc_id", "template", "licence", "position").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.count("*").alias("both"))
    dice = (2.0 * F.col("both")) / (F.col("n") + F.col("size"))
    return both.select("doc_id", "row", F.lit("passage").alias("unit"), "position", "template", "licence", dice.alias("dice")).filter(F.col("dice") >= threshold)


def licences(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit, position (from 0), licence, dice: the best licence of each unit that reaches the threshold.

    Ties go to the licence that sorts first. Null and empty texts have no units; rows that repeat
    give repeated results; a null doc_id stays null.
    """
    spark = docs.sparkSession
    index = F.broadcast(spark.createDataFrame(inverted(templates), "bigram string, template int, licence string, size int"))  # a fixed table
    sizes = [len(_bigrams(text)) for _, text in templates]
    ratio = (2 - threshold) / threshold
    low, high = min(sizes) / ratio - _SLACK, max(sizes) * ratio + _SLACK
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    # The search for anchors is the dearest step, and three passes need its result: it runs once, and the texts that are left are written.
    hopeful = stage(numbered.filter(F.col("text").rlike(f"(?i)(?<![0-9a-z])(?:{'|'.join(anchors(templates, threshold))})(?![0-9a-z])")))
    rows = hopeful.select("doc_id", "row", F.inline(_units(F.col("text"))))
    words = rows.select("doc_id", "row", "unit", "position", F.filter(F.split("body", "[ \n]+"), lambda w: w != "").alias("words"))
    # A unit of n words has n - 1 bigrams at most, so fewer words can be left out at once.
    sized = words.filter(F.size("words") - 1 >= low)
    grams = F.array_distinct(F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    sets = sized.select("doc_id", "row", "unit", "position", grams.alias("grams")).filter(F.size("grams").between(low, high))
    pairs = sets.select("doc_id", "row", "unit", "position", F.size("grams").alias("n"), F.explode("grams").alias("bigram")).join(index, "bigram")
    bounded = pairs.filter((F.col("n") >= F.col("size") / ratio - _SLACK) & (F.col("n") <= F.col("size") * ratio + _SLACK))
    # Texts are keys, not values, of an aggregate: so it hashes, and sorts no bigrams.
    counted = bounded.groupBy("row", "doc_id", "unit", "position", "template", "licence").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.count("*").alias("both"))
    dice = (2.0 * F.col("both")) / (F.col("n") + F.col("size"))
    units = counted.withColumn("dice", dice).filter(F.col("dice") >= threshold).select("doc_id", "row", "unit", "position", "template", "licence", "dice")
    best = Window.partitionBy("row", "unit", "position").orderBy(F.desc("dice"), "licence", "template")
    return units.unionByName(passages(hopeful, index, threshold)).withColumn("place", F.row_number().over(best)).filter("place = 1").select("doc_id", "unit", "position", "licence", "dice")


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL, over every pair of a unit and a template."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(licence)}, {quoted(text)})" for i, (licence, text) in enumerate(templates))
    words = lambda x: f"list_filter(string_split_regex(regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), '[^0-9a-z]+', ' ', 'g'), ' '), lambda w: w <> '')"
    grams = lambda x: f"list_distinct(list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]))"
    return f"""
        with template as (select *, {words("body")} as w from (values {values}) t(template, licence, body)),
        tset as (select template, licence, {grams("w")} as g from template),
        clean as (select doc_id, row_number() over () as row, regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '[^0-9a-z' || chr(10) || ']+', ' ', 'g') as c from documents where text is not null),
        paragraphs as (select *, string_split_regex(c, chr(10) || ' ?' || chr(10) || '[ ' || chr(10) || ']*') as p from clean),
        unit as (
            select doc_id, row, 'line' as unit, unnest(range(len(string_split(c, chr(10))))) as position, unnest(string_split(c, chr(10))) as body from clean
            union all
            select * from (select doc_id, row, 'paragraph', unnest(range(len(p))), unnest(p) as body from paragraphs) where contains(body, chr(10))
            union all
            select doc_id, row, 'document', 0, c from paragraphs where len(p) > 1
        ),
        uwords as (select *, {words("body")} as w from unit),
        uset as (select doc_id, row, unit, position, {grams("w")} as g from uwords where len(w) > 1),
        scored as (
            select u.*, t.template, t.licence, 2.0::double * len(list_intersect(u.g, t.g)) / (len(u.g) + len(t.g)) as dice
            from uset u join tset t on len(list_intersect(u.g, t.g)) > 0
        ),
        line as (
            select *, {words("body")} as w from (select doc_id, row, unnest(range(len(string_split(c, chr(10))))) as position, unnest(string_split(c, chr(10))) as body from clean)
        ),
        ranked as (select *, row_number() over (partition by row order by position) as rank, {grams("w")} as g from line where len(w) >= 2),
        belong as (
            select r.row, r.doc_id, r.rank, r.position, r.w, t.template, rank - row_number() over (partition by row, template order by rank) as island
            from ranked r join tset t on 2 * len(list_intersect(r.g, t.g)) >= len(r.g)
        ),
        run as (select row, doc_id, template, min(position) as position, flatten(list(w order by rank)) as w from belong group by row, doc_id, template, island having count(*) > 1),
        passage as (
            select doc_id, row, 'passage' as unit, position, p.template, t.licence, 2.0::double * len(list_intersect(p.g, t.g)) / (len(p.g) + len(t.g)) as dice
            from (select *, {grams("w")} as g from run) p join tset t using (template)
        ),
        every as (select doc_id, row, unit, position, template, licence, dice from scored union all select * from passage)
        select doc_id, unit, position::bigint as position, licence, dice from every where dice >= {threshold}::double
        qualify row_number() over (partition by row, unit, position order by dice desc, licence, template) = 1
    """


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))
