"""License scans: windows of words against licence templates by Dice coefficient over word bigrams, in DataFrame functions only.

Texts are lower-cased, and everything but letters and digits counts as a gap, so it makes no
difference how a notice is wrapped. A window begins where an anchor lies at the same offset as in
the template. It has the template's length, or ends where the anchor nearest to the template's end leaves
its last word (other words were put in or left out), within the size bounds: two windows a start at most,
cut from a run of RUN words, so work grows with the notices in a text and no row holds a long text twice.
Of windows that start near each other the best one is a notice; n_units counts notices. Anchors are bigrams with an anchor word. The size bounds prune by them: a window of b bigrams that
reaches the threshold with a template of a bigrams shares at least t * a / (2 - t) with it, and a
template has more anchors than it may miss; so a text without any anchor word is not even split
into words, and a template is only compared where one of its anchors stands. Templates are a short
fixed list, so tables of their bigrams may be broadcast.

Defined cases: null or empty texts and texts of fewer than two words match nothing; ties of a
licence's score keep one row; repeated rows count once; texts of one id are counted together; a
null id is an id of its own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.8
RUN = 4096
"""Words of a text that windows are cut from at once, and the longest window beside."""
PER, FAR = 1000, 1_000_000_000
"""Starts are compared in thousandths of the template's length; no text has FAR words."""
MAX_TEMPLATES = 2000
"""More templates than this are refused, so that their table stays small."""

# Words that are too common in any text to be anchors.
COMMON = frozenset(
    "a all an and any are as at author be but by can conditions copy event for free from general granted has have in including is it may must no not notice of on or other out person program"
    " provided public purpose released source state such terms text that the this to under use used version we will with without work works you your if into either following forms act law code anyone extent particular subject shall contract copies 0 1 2 3 4".split()
)

# Notices by which texts name their licence, and the texts of short licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See the LICENSE file in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
)


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def anchors(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> tuple[list[str], list[tuple[str, str, int, int]]]:
    """Anchor words, and for every template its anchors: (template's words, bigram, offset, number of words).

    Words are taken one after another, each time the one that adds most to the anchors that
    templates lack, until each has one more than the bigrams that a window may miss.
    """
    told = [_words(notice) for _, notice in templates]
    pairs = [Counter(zip(w, w[1:], strict=False)) for w in told]
    lack = [len(p) - ceil(len(p) * threshold / (2 - threshold) - 1e-9) + 1 if p else 0 for p in pairs]
    chosen: list[str] = []
    for common in (False, True):
        while True:
            gain: Counter[str] = Counter()
            for p, n in zip(pairs, lack, strict=True):
                left = n - sum(a in chosen or b in chosen for a, b in p)
                if left > 0:
                    own = Counter(w for a, b in p if a not in chosen and b not in chosen for w in {a, b} if common or w not in COMMON)
                    gain.update({w: min(k, left) for w, k in own.items()})
            if not gain:
                break
            chosen.append(min(gain, key=lambda w: (-gain[w], w)))
    rows = {(" ".join(w), f"{a} {b}", k, len(w)) for w in told for k, (a, b) in enumerate(zip(w, w[1:], strict=False)) if a in chosen or b in chosen}
    return sorted(chosen), sorted(rows)


def split(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^a-z0-9\x{80}-\x{10ffff}]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Pairs of neighbouring words."""
    return F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, score (the best), n_units (notices that match)."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"{len(templates)} templates, at most {MAX_TEMPLATES}")
    spark = docs.sparkSession
    found, rows = anchors(templates, threshold)
    known = spark.createDataFrame([(" ".join(_words(notice)), license) for license, notice in templates], "template string, license string").where("template like '% %'").distinct()
    known = known.groupBy("template").agg(F.array_sort(F.collect_set("license")).alias("licenses")).withColumn("own", F.array_distinct(bigrams(F.split("template", " "))))
    table = spark.createDataFrame(rows, "template string, gram string, off int, n_words int")
    part = "|".join(f"{w}(?<![a-z0-9]{w})(?![a-z0-9])" for w in found)
    able = F.col("text").rlike(f"(?i)(?=[{''.join(sorted({w[0] for w in found}))}])(?:{part})") if found else F.lit(False)
    key = [F.xxhash64("text").alias("k0"), F.xxhash64(F.lit(1), "text").alias("k1")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *key).where(able).select("doc_id", "k0", "k1", split(F.col("text")).alias("words")).dropDuplicates(["doc_id", "k0", "k1"])
    placed = texts.select("doc_id", "k0", "k1", F.size("words").alias("size"), F.posexplode(bigrams(F.col("words"))).alias("at", "gram")).join(F.broadcast(table), "gram")
    text, own = ["doc_id", "k0", "k1"], ["doc_id", "k0", "k1", "template"]
    placed = placed.select(*own, "n_words", F.greatest(F.least(F.col("at") - F.col("off"), F.col("size") - F.col("n_words")), F.lit(0)).alias("start"), "off")
    starts = placed.groupBy(*own, "n_words", "start").agg(F.max("off").alias("off"))
    # A window may end where the anchor nearest to the template's end says, of those whose start is near enough.
    near = Window.partitionBy(*own).orderBy(F.expr(f"start * {PER} div n_words")).rangeBetween(-(PER // 3), PER // 2)
    last = F.max(F.col("off").cast("long") * F.lit(FAR) + F.col("start")).over(near) % FAR
    windows = starts.withColumn("last", last).withColumn("length", F.explode(F.array_distinct(F.array(F.col("n_words").cast("long"), F.col("n_words") + F.col("last") - F.col("start")))))
    # Texts are cut into runs of words, so a window meets its own run, not the whole text.
    longest = max((n for *_, n in rows), default=0) * 3 // 2 + 1
    run = lambda b: F.struct(b.alias("run"), F.slice("words", b * RUN + 1, F.lit(RUN + longest)).alias("piece"))
    runs = texts.select(*text, F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(words) - 1) div {RUN} as int)")), run)).alias("x")).select(*(F.col(c).alias(f"{c}_") for c in text), "x.run", "x.piece")
    windows = windows.withColumn("run_", F.expr(f"cast(start div {RUN} as int)"))
    same = windows["doc_id"].eqNullSafe(runs["doc_id_"]) & (windows["k0"] == runs["k0_"]) & (windows["k1"] == runs["k1_"]) & (windows["run_"] == runs["run"])
    cut = F.array_distinct(bigrams(F.slice("piece", (F.col("start") % RUN + 1).cast("int"), F.col("length").cast("int"))))
    units = windows.join(runs.hint("shuffle_merge"), same).select(*own, "n_words", "start", "length", cut.alias("grams")).join(F.broadcast(known), "template")
    dice = F.transform(F.array("grams"), lambda g: 2.0 * F.size(F.array_intersect(g, F.col("own"))) / (F.size(g) + F.size("own")))[0]
    found_units = units.select(*own, "licenses", "n_words", "start", "length", dice.alias("score")).where(F.col("score") >= threshold)
    # Windows of a notice start near each other; the best one stands for it.
    order = Window.partitionBy(*own).orderBy("start", "length")
    before = F.lag("start").over(order)
    units = found_units.withColumn("new", (before.isNull() | ((F.col("start") - before) * 3 > F.col("n_words"))).cast("long")).withColumn("unit", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("score", (-F.col("start")).alias("s"), (-F.col("length")).alias("l"))).alias("b")
    notices = units.groupBy(*own, "licenses", "unit").agg(best).select(*text, F.explode("licenses").alias("license"), F.col("b.score").alias("score"), (-F.col("b.s")).alias("start"), (-F.col("b.l")).alias("length"))
    # Notices of one licence that share more than a quarter of the shorter one are one: a short form within a long one.
    before = Window.partitionBy(*text, "license").orderBy("start", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max((F.col("start") + F.col("length")) * F.lit(FAR) + F.col("length")).over(before)
    shared = F.expr(f"_reach div {FAR}") - F.col("start")
    notices = notices.withColumn("_reach", reach).withColumn("new", (F.col("_reach").isNull() | (shared * 4 <= F.least("length", F.col("_reach") % FAR))).cast("long"))
    return notices.groupBy("doc_id", "license").agg(F.round(F.max("score"), 6).alias("score"), F.sum("new").alias("n_units"))


def oracle() -> str:
    """The same scan in DuckDB's SQL."""
    quote = lambda x: x.replace("'", "''")
    _, rows = anchors()
    known = ", ".join(sorted({f"('{name}', '{quote(' '.join(_words(notice)))}')" for name, notice in TEMPLATES}))
    table = ", ".join(f"('{quote(t)}', '{quote(g)}', {off}, {n})" for t, g, off, n in rows)
    grams = "list_distinct(list_transform(generate_series(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
WITH t AS (SELECT license, template, {grams.format("string_split(template, ' ')")} AS own FROM (VALUES {known}) v(license, template)),
k AS (SELECT * FROM (VALUES {table}) v(template, gram, off, n_words)),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x{{80}}-\\x{{10ffff}}]+'), lambda x: x <> '') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
g AS (SELECT r, unnest(generate_series(1, len(w) - 1)) AS i, len(w) AS size, w FROM d WHERE len(w) > 1),
s AS (SELECT r, template, n_words, greatest(least(i - 1 - off, size - n_words), 0) AS start, max(off) AS off FROM (SELECT r, i, size, w[i] || ' ' || w[i + 1] AS gram FROM g) JOIN k USING (gram) GROUP BY ALL),
e AS (SELECT *, max(off::BIGINT * {FAR} + start) OVER (PARTITION BY r, template ORDER BY start * {PER} // n_words RANGE BETWEEN {PER // 3} PRECEDING AND {PER // 2} FOLLOWING) % {FAR} AS last FROM s),
v AS (SELECT DISTINCT r, template, n_words, start, unnest([n_words::BIGINT, n_words + last - start]) AS length FROM e),
b AS (SELECT v.*, {grams.format("d.w[start + 1 : start + length]")} AS grams FROM v JOIN d USING (r)),
m AS (SELECT DISTINCT r, template, n_words, start, length, 2.0 * len(list_intersect(grams, own)) / (len(grams) + len(own)) AS score FROM b JOIN t USING (template)),
u AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY start, length) AS unit FROM (
  SELECT *, CAST(coalesce((start - lag(start) OVER (PARTITION BY r, template ORDER BY start, length)) * 3 > n_words, true) AS INT) AS new FROM m WHERE score >= {THRESHOLD})),
n AS (SELECT r, template, score, start, length FROM u QUALIFY row_number() OVER (PARTITION BY r, template, unit ORDER BY score DESC, start, length) = 1),
q AS (SELECT r, license, score, start, length, max((start + length) * {FAR} + length) OVER (PARTITION BY r, license ORDER BY start, length DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n JOIN t USING (template))
SELECT doc_id, license, round(CAST(max(score) AS DOUBLE), 6) AS score, CAST(count(*) FILTER (reach IS NULL OR (reach // {FAR} - start) * 4 <= least(length, reach % {FAR})) AS BIGINT) AS n_units FROM q JOIN d USING (r) GROUP BY doc_id, license"""
