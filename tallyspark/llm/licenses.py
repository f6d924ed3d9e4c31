"""License scans with DataFrame functions only.

Texts are normalised (lower case, everything but a-z, 0-9 and line ends becomes a blank) and compared with license
templates by the Dice coefficient over their sets of word bigrams, 2|A and B| / (|A| + |B|): the whole text, and each
of its lines. A template is compared only if the sizes allow the threshold, t|B| <= (200 - t)|A| and t|A| <= (200 - t)|B|
with t in per cent.

Most units leave before their bigrams are made, by bounds that words alone give: a unit of w words, v of them distinct, has
at least v - 1 and at most w - 1 bigrams; and one that matches a template has so many of its bigrams that some must have one
of the template's signal words (signal_words()). What is left is compared with an array of all templates by one expression,
which does not grow with their number. All runs within a row: no shuffle, and no group that could be large.

Null texts count as empty. Units of fewer than two words have no bigrams and match nothing. Of templates with equal
coefficients the first by name counts. Repeated rows give a row each; very long texts are read whole; columns but doc_id
and text are not read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Per cent; sizes and coefficients are compared in whole numbers.
THRESHOLD = 80

# Well-known license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "BSD-3-Clause-source": 'Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def template_bigrams(text: str) -> list[str]:
    """A template's distinct word bigrams, normalised as the texts are."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def normalise(text) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\n]+", " ")


def bigrams(words) -> Column:
    """Distinct bigrams of an array of words."""
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.when(b.isNotNull() & (a != "") & (b != ""), F.concat(a, F.lit(" "), b))))


def signal_words(templates: dict[str, str], threshold: int) -> list[str]:
    """Words of which every unit that matches a template has at least one.

    A unit of the smallest size in reach still has t|B| / (200 - t) of the template's bigrams, so it lacks at most the rest;
    the words chosen, long ones first, as they are rare elsewhere, are in more bigrams than that.
    """
    chosen: set[str] = set()
    for name in sorted(templates):
        grams = [g.split(" ") for g in template_bigrams(templates[name])]
        lacks = len(grams) + -threshold * len(grams) // (200 - threshold)
        for word in sorted({w for g in grams for w in g}, key=lambda w: (w not in chosen, -len(w), w)):
            if sum(bool(chosen & set(g)) for g in grams) > lacks:
                break
            chosen.add(word)
    return sorted(chosen)


def best_match(grams, templates: dict[str, str], threshold: int) -> Column:
    """The struct (dice, name) of the best template at or above the threshold, or null; grams is an array column."""
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(own).alias("grams"), F.lit(len(own)).alias("n")) for name, own in sorted((k, template_bigrams(t)) for k, t in templates.items())])
    size = F.size(grams)

    def compare(t: Column) -> Column:
        common = F.size(F.array_intersect(grams, t["grams"]))
        in_reach = ((200 - threshold) * size >= threshold * t["n"]) & (threshold * size <= (200 - threshold) * t["n"])
        dice = F.struct((2.0 * common / (size + t["n"])).alias("dice"), t["name"].alias("name"))
        return F.when(in_reach, F.when(200 * common >= threshold * (size + t["n"]), dice))

    hits = F.filter(F.transform(known, compare), lambda h: h.isNotNull())
    return F.try_element_at(F.array_sort(hits, _by_dice), F.lit(1))


def _by_dice(a, b) -> Column:
    return F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """For each row: its lines, those that match a template, the best matching line's template and coefficient, and the whole text's."""
    sizes = [len(template_bigrams(t)) for t in templates.values()]
    least, most = -(-threshold * min(sizes) // (200 - threshold)), (200 - threshold) * max(sizes) // threshold
    signals = F.lit(signal_words(templates, threshold))
    text = normalise(F.col("text"))
    words = lambda u: F.split(F.trim(u), " ")
    # cheapest bound first
    hopeful = lambda w: F.when(F.size(w) > least, F.when(F.arrays_overlap(w, signals), F.size(F.array_distinct(w)) - 1 <= most))
    grams = lambda w: F.filter(bigrams(w), lambda g: g.isNotNull())
    in_reach = lambda g: ((200 - threshold) * F.size(g) >= threshold * min(sizes)) & (threshold * F.size(g) <= (200 - threshold) * max(sizes))
    rows = docs.select("doc_id", text.alias("norm")).select("doc_id", F.split("norm", "\n").alias("lines"), words(F.regexp_replace("norm", r"[\n ]+", " ")).alias("whole"))
    units = F.filter(F.transform(F.filter(F.transform("lines", words), hopeful), grams), in_reach)
    rows = rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), units.alias("units"), F.when(hopeful(F.col("whole")), grams(F.col("whole"))).alias("whole"))
    rows = rows.select("doc_id", "n_lines", F.filter(F.transform("units", lambda g: best_match(g, templates, threshold)), lambda h: h.isNotNull()).alias("hits"), F.when(in_reach(F.col("whole")), best_match(F.col("whole"), templates, threshold)).alias("whole"))
    best = F.try_element_at(F.array_sort("hits", _by_dice), F.lit(1))
    return rows.select(
        "doc_id",
        "n_lines",
        F.size("hits").cast("long").alias("license_lines"),
        best["name"].alias("line_license"),
        F.round(best["dice"], 6).alias("line_dice"),
        F.col("whole.name").alias("text_license"),
        F.round(F.col("whole.dice"), 6).alias("text_dice"),
    )


def oracle(templates: dict[str, str] = TEMPLATES, threshold: int = THRESHOLD) -> str:
    """DuckDB SQL for scan() of the table documents."""
    rows = ",\n".join(f"('{n}', [{', '.join(repr(g) for g in template_bigrams(t))}])" for n, t in sorted(templates.items()))
    return rf"""
with t(name, grams) as (values {rows}),
n as (select doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') as norm from documents),
u as (select doc_id, 1 as whole, regexp_replace(norm, '[\n ]+', ' ', 'g') as unit, 0 as k from n
      union all
      select doc_id, 0, unnest(string_split(norm, chr(10))), unnest(range(len(string_split(norm, chr(10))))) from n),
w as (select doc_id, whole, k, list_filter(string_split(trim(unit), ' '), lambda x: x <> '') as words from u),
g as (select doc_id, whole, k, list_distinct(list_transform(range(1, greatest(len(words), 1)), lambda i: concat(words[i], ' ', words[i + 1]))) as grams from w),
d as (select g.doc_id, g.whole, g.k, t.name, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) as dice,
      200 * len(list_intersect(g.grams, t.grams)) >= {threshold} * (len(g.grams) + len(t.grams)) as alike
      from g join t on {200 - threshold} * len(g.grams) >= {threshold} * len(t.grams) and {threshold} * len(g.grams) <= {200 - threshold} * len(t.grams)),
b as (select doc_id, whole, k, name, dice, row_number() over (partition by doc_id, whole, k order by dice desc, name) as r from d where alike),
l as (select doc_id, count(*) as license_lines, min_by(name, struct_pack(a := -dice, b := name)) as name, max(dice) as dice from b where r = 1 and whole = 0 group by 1)
select n.doc_id, cast(len(string_split(n.norm, chr(10))) as bigint) as n_lines, coalesce(l.license_lines, 0) as license_lines,
       l.name as line_license, round(l.dice, 6) as line_dice, b.name as text_license, round(b.dice, 6) as text_dice
from n left join l on n.doc_id = l.doc_id left join b on n.doc_id = b.doc_id and b.whole = 1 and b.r = 1
"""
