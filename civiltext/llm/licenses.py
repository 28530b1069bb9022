"""License scans: texts against license templates by the Dice coefficient of word bigrams.

A text is compared as a whole, by its blocks between blank lines, line by line, and by passages,
so that a license file, a header, a one-line notice, a license of several paragraphs within a
document and a notice in mid-line are all found. A unit is normalised (lower case, letters and
digits only) and seen as the set of its word pairs. For two sets of a and b pairs Dice is at
most 2·min(a, b)/(a + b), so only templates within a size bound of the unit can reach the
threshold, and a text that lacks too many pairs of each template, as most of a corpus, is never
compared. Of the templates that reach it the best one names the unit, ties by name.

A passage is a stretch of words, of any begin and end, that is more like a template than those
it overlaps. It counts unless a unit around it has the same license or is as much like its own.
A unit does not count that lies for the most part in a passage more like another license.
Native expressions only, each text within its row.

A null or empty text has no license. Repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.llm.common import documents, let, text_or_empty

LEAST = 0.75
# Notices of public licenses, by their public short names. Years and names of holders are left out.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
# Complete notices and short full texts besides. The SQL twin knows the list above only, and no passages.
_ANY = "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gnu(kind: str, version: str, where: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but {_ANY} See the GNU {kind} for more details. You should have received a copy of the GNU {kind} along with this program. If not, {where}"


_SEE = "see https://www.gnu.org/licenses/."
_WRITE = "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
NOTICES = (
    ("GPL-3.0", _gnu("General Public License", "3", _SEE)),
    ("GPL-2.0", _gnu("General Public License", "2", _SEE)),
    ("GPL-2.0", _gnu("General Public License", "2", _WRITE)),
    ("GPL-2.0", _gnu("General Public License", "2", "").partition(" You should")[0]),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3", _SEE)),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3", "").partition(" You should")[0]),
    ("AGPL-3.0", _gnu("Affero General Public License", "3", _SEE)),
    ("AGPL-3.0", _gnu("Affero General Public License", "3", "").partition(" You should")[0]),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org'),
)
ALL_TEMPLATES = TEMPLATES + NOTICES
NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " ")), " ", -1)


def hashes_of(words: Column) -> Column:
    """Hashes of the word pairs in order. Fewer than two words have none."""
    joined = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1))
    )
    return F.when(F.size(words) < 2, F.expr("CAST(array() AS array<bigint>)")).otherwise(joined)


def pairs_of(words: Column) -> Column:
    """Hashes of the different word pairs."""
    return F.array_distinct(hashes_of(words))


def prepared(spark: SparkSession, templates: tuple[tuple[str, str], ...] = ALL_TEMPLATES) -> list[tuple[str, list[int]]]:
    """Names and pairs of the templates, a fixed list."""
    rows = spark.createDataFrame(list(templates), "name string, text string")
    return [(r.name, sorted(r.pairs)) for r in rows.select("name", let(words_of(F.col("text")), pairs_of).alias("pairs")).collect()]


def _longs(values: list[int]) -> str:
    return f"array({', '.join(f'{v}L' for v in values)})"


def matches(text: Column, templates: list[tuple[str, list[int]]], least: float = LEAST) -> Column:
    """An array of `(unit, license, dice)`, units in order: the whole text, its blocks, its lines, passages."""
    sizes = [len(p) for _, p in templates]
    # what has the least coefficient with a template shares so much of it, and has so many times its pairs at most
    share, times = least / (2 - least), (2 - least) / least
    shortest, longest = min(sizes) * share, max(sizes) * times
    every = F.expr(_longs(sorted({p for _, own in templates for p in own})))
    known = F.expr("array(" + ", ".join(f"named_struct('license', '{name}', 'pairs', {_longs(own)})" for name, own in templates) + ")")
    nothing = F.expr("CAST(array() AS array<struct<unit: int, license: string, dice: double>>)")

    def reachable(hashes: Column) -> Column:
        """Templates of which the text holds enough pairs, wherever they are."""
        enough = let(F.array_intersect(hashes, every), lambda c: F.when(
            F.size(c) >= shortest, F.filter(known, lambda t: F.size(F.array_intersect(c, t["pairs"])) >= F.size(t["pairs"]) * share - 1e-9)
        ))
        return F.coalesce(enough, F.slice(known, 1, 0))

    def minus_dice(pairs: Column, own: Column) -> Column:
        return -(F.lit(2.0) * F.size(F.array_intersect(pairs, own)) / (F.size(pairs) + F.size(own)))

    def judged(words: Column, near: Column) -> Column:
        def best(pairs: Column) -> Column:
            fitting = F.filter(near, lambda t: F.size(pairs).between(F.size(t["pairs"]) * share, F.size(t["pairs"]) * times))
            scored = F.transform(fitting, lambda t: F.struct(minus_dice(pairs, t["pairs"]).alias("minus"), t["license"].alias("license")))
            # the largest coefficient, then the first name
            return F.get(F.array_sort(F.filter(scored, lambda x: -x["minus"] >= least)), F.lit(0))

        # words bound the number of pairs; a unit with too few needs no comparison
        return F.when(F.size(words) - 1 >= shortest, let(pairs_of(words), lambda p: F.when(F.size(p).between(shortest, longest), best(p))))

    def stretches(hashes: Column, template: Column) -> Column:
        """Stretches from the begin of a run of the template's pairs to the end of one. The best stretch is one of them,
        since a further pair of the template at either end never makes the coefficient smaller."""
        own = template["pairs"]
        most = F.floor(F.size(own) * times).cast("int")

        def of(at: Column) -> Column:
            places = F.transform(at, lambda x, k: F.struct(x.alias("at"), k.alias("k")))
            first = F.filter(places, lambda x: (x["k"] == 0) | (F.get(at, x["k"] - 1) < x["at"] - 1))
            last = F.filter(places, lambda x: (x["k"] == F.size(at) - 1) | (F.get(at, x["k"] + 1) > x["at"] + 1))

            def ends(lasts: Column) -> Column:
                return F.flatten(F.transform(first, lambda a, r: F.transform(
                    F.filter(
                        F.slice(lasts, r + 1, F.floor(most / 2).cast("int") + 1),
                        lambda b, i: (b["k"] - a["k"] + 1 >= F.size(own) * share - 1e-9) & ((i == 0) | (b["at"] - a["at"] < most)),
                    ),
                    lambda b: F.struct(
                        minus_dice(F.array_distinct(F.slice(hashes, a["at"], b["at"] - a["at"] + 1)), own).alias("minus"),
                        (a["at"] - b["at"]).alias("minus_length"), template["license"].alias("license"), a["at"].alias("first"), b["at"].alias("last"),
                    ),
                )))

            return let(last, ends)

        return let(F.filter(F.sequence(F.lit(1), F.size(hashes)), lambda i: F.array_contains(own, F.element_at(hashes, i))), of)

    def passages(hashes: Column, near: Column) -> Column:
        """Stretches that reach `least`, the best of those that overlap: by coefficient, length and name."""
        found = F.filter(F.flatten(F.transform(near, lambda t: stretches(hashes, t))), lambda x: -x["minus"] >= least)
        return let(F.array_sort(found), lambda s: F.aggregate(s, F.slice(s, 1, 0), lambda kept, x: F.when(
            F.exists(kept, lambda k: (k["first"] <= x["last"]) & (x["first"] <= k["last"])), kept
        ).otherwise(F.concat(kept, F.array(x)))))

    def part_of_word(parts: Column) -> Column:
        """For each word of the text the part that it is in."""
        return F.flatten(F.transform(parts, lambda x, i: let(words_of(x), lambda w: F.array_repeat(i, F.when(F.get(w, F.lit(0)) == "", 0).otherwise(F.size(w))))))

    lines = F.split(text, "\n", -1)
    blocks = F.split(text, r"\n[\x20\t\r]*\n", -1)

    def compared(words: Column, hashes: Column, near: Column) -> Column:
        parts = F.concat(F.when(F.size(blocks) > 1, blocks).otherwise(F.array()), F.when(F.size(lines) > 1, lines).otherwise(F.array()))
        before_lines = F.when(F.size(blocks) > 1, F.size(blocks)).otherwise(0) + 1

        def numbered(named: Column) -> Column:
            rows = F.transform(named, lambda m, i: F.struct(i.alias("unit"), m["license"].alias("license"), (-m["minus"]).alias("dice")))
            return F.filter(rows, lambda x: x["license"].isNotNull())

        def beside(named: Column, found: Column, in_block: Column, in_line: Column) -> Column:
            def half_in(i: Column, x: Column) -> Column:
                """Whether more than half of the words of unit `i` are in the passage."""
                in_part = F.when(i < before_lines, in_block).otherwise(in_line)
                part = i - F.when(i < before_lines, F.lit(1)).otherwise(before_lines)
                start = F.when(i == 0, F.lit(1)).otherwise(F.array_position(in_part, part))
                return let(F.size(words_of(F.when(i == 0, text).otherwise(F.get(parts, i - 1)))), lambda n: (
                    2 * (F.least(x["last"] + 2, start + n) - F.greatest(x["first"], start)) > n
                ))

            def kept(m: Column, i: Column) -> Column:
                """A part of another license names no license of its own."""
                better = F.exists(found, lambda x: (x["minus"] < m["minus"]) & (x["license"] != m["license"]) & half_in(i, x))
                return F.when(m.isNotNull() & ~better, m)

            def told(units: Column, x: Column) -> Column:
                """Whether a unit around the passage has its license, or is as much like its own one."""
                def same(split: Column, of_word: Column, offset: Column) -> Column:
                    a, b = F.element_at(of_word, x["first"]), F.element_at(of_word, x["last"] + 1)
                    return F.when((F.size(split) > 1) & (a == b), F.get(units, a + offset))

                around = F.array(F.get(units, F.lit(0)), same(blocks, in_block, F.lit(1)), same(lines, in_line, before_lines))
                return F.exists(around, lambda u: F.coalesce((u["license"] == x["license"]) | (u["minus"] <= x["minus"]), F.lit(False)))

            def both(units: Column) -> Column:
                others = F.transform(
                    F.filter(found, lambda x: ~told(units, x)),
                    lambda x, i: F.struct((F.size(units) + i).alias("unit"), x["license"].alias("license"), (-x["minus"]).alias("dice")),
                )
                return F.concat(numbered(units), others)

            return let(F.transform(named, kept), both)

        def with_units(named: Column) -> Column:
            return let(passages(hashes, near), lambda found: F.when(F.size(found) == 0, numbered(named)).otherwise(
                let(part_of_word(blocks), lambda in_block: let(part_of_word(lines), lambda in_line: beside(named, found, in_block, in_line)))
            ))

        units = F.concat(F.array(judged(words, near)), F.transform(parts, lambda x: let(words_of(x), lambda w: judged(w, near))))
        return let(units, with_units)

    return let(words_of(text), lambda words: let(hashes_of(words), lambda hashes: let(
        reachable(hashes), lambda near: F.when(F.size(near) > 0, compared(words, hashes, near)).otherwise(nothing)
    )))


def scan(docs: DataFrame, least: float = LEAST, templates: tuple[tuple[str, str], ...] = ALL_TEMPLATES, into: str = "licenses") -> DataFrame:
    """`docs` with a column `into (unit, license, dice)`, in place of one of that name."""
    own = prepared(docs.sparkSession, templates)
    others = [docs[c] for c in docs.columns if c != into]
    return docs.select(*others, F.explode(F.array(matches(text_or_empty("text"), own, least))).alias(into))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of units with a license, the different ones in order, and the best coefficient (0 without)."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("bigint").alias("n_units"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("licenses", lambda x: x["dice"])), F.lit(0.0)), 6).alias("best_dice"),
    )


def _sql() -> str:
    listed = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES))

    def pairs(text: str) -> str:
        words = f"string_split(trim(regexp_replace(lower({text}), '{NOT_WORD}', ' ', 'g'), ' '), ' ')"
        return f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"

    return rf"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT doc_id, 'whole' AS part, 0 AS i, text AS unit FROM texts
  UNION ALL SELECT doc_id, 'block', unnest(range(len(b))), unnest(b) FROM (SELECT doc_id, string_split_regex(text, '\n[\x20\t\r]*\n') AS b FROM texts) WHERE len(b) > 1
  UNION ALL SELECT doc_id, 'line', unnest(range(len(l))), unnest(l) FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM texts) WHERE len(l) > 1),
words AS (SELECT doc_id, part, i, string_split(trim(regexp_replace(lower(unit), '{NOT_WORD}', ' ', 'g'), ' '), ' ') AS w FROM units),
sets AS (SELECT doc_id, part, i, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS s FROM words),
templates AS (SELECT t, license, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS p
  FROM (SELECT t, license, string_split(trim(regexp_replace(lower(x), '{NOT_WORD}', ' ', 'g'), ' '), ' ') AS w FROM (VALUES {listed}) v(t, license, x))),
scored AS (SELECT doc_id, part, i, license, 2.0::DOUBLE * len(list_intersect(s, p)) / (len(s) + len(p)) AS dice
  FROM sets JOIN templates ON len(s) >= len(p) * {LEAST} / {2 - LEAST} AND len(s) <= len(p) * {2 - LEAST} / {LEAST}),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part, i ORDER BY dice DESC, license) AS r FROM scored WHERE dice >= {LEAST}),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS dice FROM best WHERE r = 1 GROUP BY doc_id)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_units, coalesce(licenses, '') AS licenses, round(coalesce(dice, 0), 6)::DOUBLE AS best_dice
FROM texts t LEFT JOIN found f ON t.doc_id = f.doc_id"""


QUERIES = {"op7_licenses": op7_licenses}
SQL = {"op7_licenses": _sql()}
