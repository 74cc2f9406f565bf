"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

The words of a line, and of every stretch of the whole text whatever its line breaks, are compared with each
template whose size allows the threshold at all: 2 |A & B| / (|A| + |B|) >= t needs
|A| >= |B| t / (2 - t) and |A| <= |B| (2 - t) / t. A line that matches as a whole is one notice; stretches count
elsewhere, so that wrapped notices and those inside a paragraph are found too.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise, table

THRESHOLD = 0.8
#: Everything but letters and digits separates words, on both sides.
SEPARATOR = r"[^\p{L}\p{N}]+"
#: Words that say little about a text; they become anchors last.
COMMON = {"a", "and", "any", "as", "at", "be", "by", "for", "in", "is", "of", "on", "or", "the", "this", "to"}
#: Fixed texts of public licence notices and of the opening paragraphs of licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
)


def word_list(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), SEPARATOR, " ")), " ")


def bounds(size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Least and most bigrams of what can match a template of ``size`` bigrams. The least also bounds the overlap."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def anchors(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words without any of which no text matches any template: so many that of each template the bigrams without them are too
    few to reach the least overlap; long words first, and those that bring most templates nearest to it."""
    pairs = [list(zip(x, x[1:])) for x in (_plain(t).split(" ") for _, t in templates)]
    words = sorted({w for x in pairs for p in x for w in p})
    out: list[str] = []
    while True:
        left = [[p for p in x if not {*p} & {*out}] for x in pairs]
        over = [max(0, len(x) - bounds(len(all_), threshold)[0] + 1) for x, all_ in zip(left, pairs)]
        if not any(over):
            return sorted(w for w in out if not any(v != w and len(v) > 4 and v in w for v in out))
        gain = Counter()
        for x, n in zip(left, over):
            if n:
                mine = Counter(w for p in x for w in {*p})
                gain.update({w: min(n, c) / n for w, c in mine.items()})
        out.append(max(words, key=lambda w: (gain[w] > 0, w not in COMMON and len(w) > 4, w not in COMMON, gain[w], len(w), w)))


def may_hold(text: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """Whether the text has one of the ``anchors``; the others cannot match and need not be taken apart."""
    words, low = anchors(templates, threshold), F.lower(text)
    out = F.lit(False)
    for w in words:
        if len(w) > 4:
            out = out | F.contains(low, F.lit(w))
    short = "|".join(w for w in words if len(w) <= 4)  # as whole words, since they stand inside many others
    return out | low.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{short})(?![\p{{L}}\p{{N}}])") if short else out


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and text of the rows that may hold a template; written once, so that texts are searched once."""
    return docs.where(F.col("text").isNotNull() & may_hold(F.col("text"))).select("doc_id", "text")


def template_frame(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """template, license, size (bigrams), bigram, n (times in the template)."""
    t = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(templates)], "template int, license string, text string")
    t = t.withColumn("w", word_list(F.col("text"))).withColumn("size", F.size("w") - 1).where("size > 0")
    t = t.select("template", "license", "size", F.col("w").alias("w"), F.explode(F.sequence(F.lit(1), F.col("size"))).alias("i"))
    t = t.select("template", "license", "size", F.concat_ws(" ", F.element_at("w", F.col("i")), F.element_at("w", F.col("i") + 1)).alias("bigram"))
    return t.groupBy("template", "license", "size", "bigram").agg(F.count(F.lit(1)).alias("n"))


def lines_that_match(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Lines that match a licence template: doc_id, line (from 0), license, template, overlap, line_size,
    template_size (word bigrams, repeats counted). Dice is 2 overlap / (line_size + template_size).

    A null text has no lines. Lines of fewer than two words match nothing. Rows that share an id are one
    document: their lines of one number are added up only if they are the same row content, see ``op8``; the id
    of a row and the checksum of its text tell rows apart. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    t = template_frame(spark, templates)
    low, high = bounds(min(_sizes(templates)), threshold)[0], bounds(max(_sizes(templates)), threshold)[1]
    lines = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("line", "x"))
    lines = lines.withColumn("w", word_list(F.col("x"))).withColumn("line_size", F.size("w") - 1).where(F.col("line_size").between(max(1, low), high))
    grams = lines.select("doc_id", "version", "line", "line_size", "w", F.explode(F.sequence(F.lit(1), F.col("line_size"))).alias("i"))
    grams = grams.select("doc_id", "version", "line", "line_size", F.concat_ws(" ", F.element_at("w", F.col("i")), F.element_at("w", F.col("i") + 1)).alias("bigram"))
    a, b = F.col("line_size"), F.col("size")
    fits = (a * (2 - threshold) >= b * threshold) & (b * (2 - threshold) >= a * threshold)
    # The templates are a constant of this module: at most a few hundred bigrams go to every executor.
    hits = grams.join(F.broadcast(t), "bigram").where(fits)
    key = ["doc_id", "version", "line", "license", "template", "line_size", "size"]
    per = hits.groupBy(*key, "bigram", "n").agg(F.count(F.lit(1)).alias("m"))
    per = per.groupBy(*key).agg(F.sum(F.least("m", "n")).alias("overlap"))
    return per.where(2 * F.col("overlap") >= threshold * (a + b)).select("doc_id", "version", "line", "license", "template", "overlap", "line_size", F.col("size").alias("template_size"))


def stretches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Stretches of a text's words that match a template, over line ends and inside lines: doc_id, version, start (bigram
    from 0), stop (its last one), first and last (lines), license, template, overlap, line_size (bigrams), template_size.

    Each bigram of the template is a start, and its best end counts (the nearest of equal ones). Of stretches that share
    words the one with the greatest overlap stays (ties: greater Dice, earlier, shorter, lesser template), so that a whole licence is
    not taken for its first sentence; those that share a line with a line that matches as a whole with no less overlap are that notice and do not appear. The best stretch of a place begins and ends with
    bigrams of the template, so no other is tried.
    """
    t = template_frame(docs.sparkSession, templates)
    row = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    row = row.dropDuplicates(["doc_id", "version"])
    grams = row.select("doc_id", "version", word_list(F.col("text")).alias("w")).where(F.size("w") > 1)
    grams = grams.select("doc_id", "version", F.posexplode(F.expr("transform(slice(w, 1, size(w) - 1), (x, i) -> concat(x, ' ', w[i + 1]))")).alias("pos", "bigram"))
    # The templates are a constant of this module: at most a few thousand bigrams go to every executor.
    hits = grams.join(F.broadcast(t), "bigram")
    key = ["doc_id", "version", "license", "template", "size"]
    # A bigram adds to the overlap if less than n of its kind stand between the start and it: if the n-th one before it lies before the start.
    kinds = hits.groupBy(*key, "bigram", "n").agg(F.sort_array(F.collect_list("pos")).alias("p"))  # at most the document's bigrams
    kinds = kinds.select(*key, F.expr("transform(p, (x, i) -> struct(x as pos, if(i >= n, p[i - n], -1) as prev))").alias("o"))
    per = kinds.groupBy(*key).agg(F.sort_array(F.flatten(F.collect_list("o"))).alias("h"))
    low, high = (F.element_at(F.array(*[F.lit(bounds(n, threshold)[k]) for n in range(1, max(_sizes(templates)) + 1)]), F.col("size")) for k in (0, 1))
    per = per.withColumn("need", low).withColumn("most", high).where(F.size("h") >= F.col("need"))
    per = per.withColumn("i", F.explode(F.expr("filter(sequence(0, size(h) - need), i -> h[i + need - 1].pos - h[i].pos < most)")))
    per = per.withColumn("start", F.expr("h[i].pos")).withColumn("part", F.expr("filter(slice(h, i + 1, most), x -> x.pos - start < most)")).drop("h")
    per = per.withColumn("best", F.expr("""aggregate(part, named_struct('n', 0L, 'overlap', 0L, 'stop', start, 'dice', 0.0D), (s, x) -> if(
      2.0D * (s.n + if(x.prev < start, 1L, 0L)) / (x.pos - start + 1 + size) > s.dice,
      named_struct('n', s.n + if(x.prev < start, 1L, 0L), 'overlap', s.n + if(x.prev < start, 1L, 0L), 'stop', x.pos, 'dice', 2.0D * (s.n + if(x.prev < start, 1L, 0L)) / (x.pos - start + 1 + size)),
      named_struct('n', s.n + if(x.prev < start, 1L, 0L), 'overlap', s.overlap, 'stop', s.stop, 'dice', s.dice)))"""))
    per = per.select("doc_id", "version", "template", "license", "size", "start", "best.overlap", "best.stop").withColumn("line_size", F.expr("stop - start + 1"))
    per = per.where(2 * F.col("overlap") >= threshold * (F.col("line_size") + F.col("size")))
    found = per.select("doc_id", "version", F.struct((-F.col("overlap")).alias("order"), (-2 * F.col("overlap") / (F.col("line_size") + F.col("size"))).alias("then"), "start", "stop", "template", "license", "overlap", "line_size", F.col("size").alias("template_size")).alias("s"))
    found = found.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("s")).alias("all"))
    # The word at which each line ends, then the lines of a stretch; a stretch has one word more than bigrams.
    counts = F.transform(F.split("text", "\n"), lambda x: F.size(F.filter(word_list(x), lambda w: w != "")))
    ends = row.select(F.col("doc_id").alias("id"), F.col("version").alias("v"), counts.alias("c")).alias("r").join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("v") == F.col("version"))).groupBy("doc_id", "version").agg(F.first("all").alias("all"), F.first("c").alias("c"))
    ends = ends.withColumn("ends", F.expr("aggregate(c, cast(array() as array<int>), (a, x) -> concat(a, array(coalesce(a[size(a) - 1], 0) + x)))".replace("a[size(a) - 1]", "try_element_at(a, -1)")))
    lined = ends.withColumn("all", F.expr("transform(all, s -> struct(s as s, size(filter(ends, e -> e <= s.start)) as first, size(filter(ends, e -> e <= s.stop + 1)) as last))"))
    whole = lines_that_match(docs, templates, threshold).groupBy("doc_id", "version").agg(F.collect_set(F.struct("line", "overlap")).alias("taken")).select(F.col("doc_id").alias("id"), F.col("version").alias("v"), "taken")
    free = lined.join(whole, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("v") == F.col("version")), "left")
    free = free.withColumn("all", F.expr("filter(all, x -> taken is null or not exists(taken, l -> l.line between x.first and x.last and l.overlap >= x.s.overlap))"))
    kept = F.expr("aggregate(all, slice(all, 1, 0), (k, x) -> if(exists(k, y -> y.s.start <= x.s.stop + 1 and x.s.start <= y.s.stop + 1), k, concat(k, array(x))))")
    return free.select("doc_id", "version", F.explode(kept).alias("x")).select("doc_id", "version", "x.first", "x.last", "x.s.*").drop("order", "then")


def notices(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The ``stretches`` by the line they begin on, and the lines that match elsewhere, see ``lines_that_match``; ``start`` is
    null for a line and the first word's place in the text for a stretch."""
    lines = lines_that_match(docs, templates, threshold).withColumn("start", F.lit(None).cast("int"))
    more = materialise(stretches(docs, templates, threshold), "licence-stretches")
    within = F.col("l.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("l.version") == F.col("m.version")) & F.col("l.line").between(F.col("m.first"), F.col("m.last"))
    alone = lines.alias("l").join(more.alias("m"), within, "left_anti")
    return alone.unionByName(more.withColumnRenamed("first", "line").select(*lines.columns))


def _sizes(templates: tuple[tuple[str, str], ...]) -> list[int]:
    return [len(_plain(x).split(" ")) - 1 for _, x in templates]


def _plain(text: str) -> str:
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in text).split())


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))


def summary(docs: DataFrame) -> DataFrame:
    """Every row: doc_id, n_notices (matching lines and stretches), licenses (sorted, comma-joined), license (of the best
    match; ties go to the least template number), dice (of it, to six places; 0 if none).

    Rows that share an id are one document; rows with a null id are judged by their own text. Null, empty and one-word texts
    have no notices. An empty table gives an empty result; other columns are ignored.
    """
    found = notices(materialise(candidates(docs), "licence-candidates"))
    dice = 2 * F.col("overlap") / (F.col("line_size") + F.col("template_size"))
    lone = lambda version: F.when(F.col("doc_id").isNull(), version).alias("lone")
    best = found.groupBy("doc_id", lone(F.col("version"))).agg(
        F.count_distinct("version", "line", F.coalesce("start", F.lit(-1))).alias("n_notices"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),  # as many as there are licences
        F.max(F.struct(dice.alias("dice"), (-F.col("template")).alias("t"), "license")).alias("best"),
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lone(F.xxhash64("text"))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("d.lone").eqNullSafe(F.col("b.lone"))
    return ids.join(best.alias("b"), same, "left").select(
        "d.doc_id", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("best.license", F.lit("")).alias("license"), F.round(F.coalesce("best.dice", F.lit(0.0)), 6).alias("dice"),
    )


def _oracle() -> str:
    q = lambda s: s.replace("'", "''")
    rows = ", ".join(f"({i}, '{x}', '{q(y)}')" for i, (x, y) in enumerate(TEMPLATES))
    norm = lambda c: f"string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    return f"""
WITH t0(template, license, x) AS (VALUES {rows}),
t1 AS (SELECT template, license, {norm('x')} AS w FROM t0),
t AS (SELECT template, license, len(w) - 1 AS size, w[i] || ' ' || w[i + 1] AS bigram, count(*) AS n
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t1) GROUP BY ALL),
l0 AS (SELECT doc_id, hash(text) AS version, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, version, line, {norm('x')} AS w FROM l0),
l AS (SELECT doc_id, version, line, len(w) - 1 AS line_size, w[i] || ' ' || w[i + 1] AS bigram, count(*) AS m
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM l1 WHERE len(w) BETWEEN 2 AND {bounds(max(_sizes(TEMPLATES)))[1] + 1}) GROUP BY ALL),
hit AS (SELECT doc_id, version, line, license, template, line_size, size, sum(least(m, n)) AS overlap FROM l JOIN t USING (bigram) GROUP BY ALL),
ok AS (SELECT *, 2 * overlap / (line_size + size) AS dice FROM hit WHERE 2 * overlap >= {THRESHOLD} * (line_size + size)),
best AS (SELECT doc_id, count(DISTINCT (version, line)) AS n_notices, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses,
  first(license ORDER BY dice DESC, template) AS license, max(dice) AS dice FROM ok GROUP BY doc_id)
SELECT doc_id, coalesce(n_notices, 0) AS n_notices, coalesce(licenses, '') AS licenses, coalesce(license, '') AS license, round(coalesce(dice, 0.0), 6) AS dice
FROM documents LEFT JOIN best USING (doc_id)
"""


ORACLE = _oracle()
