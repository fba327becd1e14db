"""License scans: windows of a text compared with license templates by the Dice coefficient of their word bigrams.

Texts and templates are normalised alike: lower-cased, everything but letters and digits a space. A window begins where a stretch of a template's bigrams begins and ends where one
ends, so notices are found on lines of their own, inside prose and wrapped over many lines alike, and edits in between only cost likeness. Two sets of a and b
bigrams can reach a coefficient t only if a lies between b t / (2 - t) and b (2 - t) / t: windows of more words are not compared, and a match shares at least
b t / (2 - t) bigrams. For the latter reason a text without any of a few KEYWORDS, which touch so many bigrams of each template that a match holds one, is
passed over. DataFrame functions alone; no shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: What normalised words are not made of. The same pattern holds in SQL.
GAP = r"[^\p{L}\p{N}]+"

# The texts of common licenses without their copyright lines, and customary notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_OPENS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_FIRST = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
_BSD_ENDS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author
or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This {program} is free software{colon} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either
version {version} of the License, or (at your option) any later version. This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this
{program}{ending}"""
_OLD_ADDRESS = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_NEW_ADDRESS = ". If not, see <https://www.gnu.org/licenses/>."


def _gnu(program: str, name: str, version: str, ending: str, colon: str = ":") -> str:
    return _GNU.format(program=program, name=f"GNU {name}General Public License", version=version, ending=ending, colon=colon)


LICENSES: dict[str, list[str]] = {
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        _gnu("program", "Affero ", "3", _NEW_ADDRESS),
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "This project is licensed under the Apache License 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        _APACHE,
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License.", f"{_BSD_OPENS} {_BSD_FIRST} {_BSD_ENDS}"],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        _BSD_OPENS,
        f"{_BSD_OPENS} {_BSD_FIRST} {_BSD_THIRD} {_BSD_ENDS}",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["Licensed under the Eclipse Public License, version 2.0."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2.",
        _gnu("program", "", "2", _OLD_ADDRESS, ";"),
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3.", _gnu("program", "", "3", _NEW_ADDRESS)],
    "ISC": ["Released under the ISC License.", "Licensed under the ISC License.", _ISC],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", _gnu("library", "Lesser ", "2.1", _OLD_ADDRESS, ";")],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", _gnu("program", "Lesser ", "3", _NEW_ADDRESS)],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", _MIT],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", _UNLICENSE],
    "Zlib": ["Released under the zlib License.", _ZLIB],
}


def words_of(text: str) -> list[str]:
    """The words of a license text, normalised."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def templates(licenses: dict[str, list[str]] | None = None) -> list[tuple[str, int, list[str]]]:
    """(license, number of the template in it, its distinct bigrams)."""
    known = LICENSES if licenses is None else licenses
    found = [(name, i, bigrams(words_of(text))) for name, texts in sorted(known.items()) for i, text in enumerate(texts)]
    if not all(grams for _, _, grams in found):
        raise ValueError("a template has two words at least")
    return found


def least_shared(size: int, threshold: float) -> int:
    """How many bigrams a set must share with one of `size` to reach the threshold."""
    return max(1, math.ceil(size * threshold / (2 - threshold) - 1e-9))


def most_words(size: int, threshold: float) -> int:
    """How many words a window may have for a template of `size` bigrams."""
    return math.floor(size * (2 - threshold) / threshold + 1e-9) + 1


def keywords(found: list[tuple[str, int, list[str]]], threshold: float) -> list[str]:
    """Words of which every match holds one: without them so many bigrams of each template are gone that the rest cannot reach the threshold.

    Chosen greedily: the word that does most for all templates not yet covered, by far sooner a long (and so a rare) one.
    """
    lacking = {(name, i): len(grams) - least_shared(len(grams), threshold) + 1 for name, i, grams in found}
    left = {(name, i): set(grams) for name, i, grams in found}
    taken: list[str] = []
    while lacking:
        gain: dict[str, float] = {}
        for key, need in lacking.items():
            touched: dict[str, int] = {}
            for gram in left[key]:
                for word in set(gram.split()):
                    touched[word] = touched.get(word, 0) + 1
            for word, many in touched.items():
                gain[word] = gain.get(word, 0.0) + min(many, need) / need * len(word) ** 3
        best = max(gain, key=lambda w: (gain[w], w))
        taken.append(best)
        for key in list(lacking):
            gone = {g for g in left[key] if best in g.split()}
            left[key] -= gone
            lacking[key] -= len(gone)
            if lacking[key] <= 0:
                del lacking[key]
    return sorted(w for w in taken if not any(o in w for o in taken if o != w))  # a text with a longer word holds the shorter one in it


def _plain(text: Column) -> Column:
    """Normalised text."""
    return F.trim(F.regexp_replace(F.lower(text), GAP, " "))


def _holds(text: Column, wanted: list[str]) -> Column:
    """Whether the text holds one of the words. An array of one element lets it be lower-cased once and not for each word."""
    return F.exists(F.array(F.lower(text)), lambda t: reduce(or_, (F.contains(t, F.lit(w)) for w in wanted)))


def scan(docs: DataFrame, threshold: float = THRESHOLD, licenses: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, first_word, last_word, license, template_no, shared, dice: one row for each window of each row's text that matches a template best.

    Words count from 0. dice is at least `threshold`. Of windows that begin at the same word the one with most shared bigrams stays, then the
    greater dice, then the first license and template by name and number, then the shorter window; of those left, one stays unless it overlaps a better one by the same order.
    Null and empty texts, and texts without licenses, give no row; texts of any length are searched whole; repeated rows, and rows with a null doc_id, give their own results;
    empty tables give none. Other columns, whatever their names, are left out.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    known = templates(licenses)
    most = max(most_words(len(g), threshold) for _, _, g in known)
    one = lambda n, i, g: F.struct(F.lit(n).alias("license"), F.lit(i).alias("template_no"), F.lit(len(g)).alias("size"), F.lit(least_shared(len(g), threshold)).alias("least"), F.lit(most_words(len(g), threshold)).alias("most"), F.split(F.lit("|".join(g)), r"\|").alias("grams"))
    table = F.array(*[one(*t) for t in known])
    every = sorted({g for _, _, grams in known for g in grams})
    kept = docs.select("doc_id", "text").where(_holds(F.col("text"), keywords(known, threshold)))
    # one expression, whose parts are bound by let(): as columns of their own they would be put into the functions that use them and built anew for each element
    words = lambda text: F.split(_plain(text), " ")
    found = let(words(F.col("text")), lambda w: let(_grams(w), lambda grams: let(F.filter(grams, lambda g: g["gram"].isin(every)), lambda some: _best(grams, some, table, threshold, most))))
    best = kept.select("doc_id", F.explode_outer(found).alias("m")).where(F.col("m").isNotNull())
    return best.select("doc_id", F.col("m.first").alias("first_word"), F.col("m.last").alias("last_word"), "m.license", "m.template_no", (-F.col("m.minus_shared")).alias("shared"), F.round(-F.col("m.minus_dice"), 6).alias("dice"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _grams(words: Column) -> Column:
    """The bigrams of a text, with the place of each one's second word."""
    gram = lambda k: F.struct(F.concat_ws(" ", F.get(words, k - 1), F.get(words, k)).alias("gram"), k.alias("place"))
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), gram))


def _best(grams: Column, some: Column, table: Column, threshold: float, most: int) -> Column:
    """The windows of a text that match best; `some` are its bigrams that any template has."""
    distinct = F.array_distinct(F.transform(some, lambda g: g["gram"]))
    near = let(distinct, lambda d: F.filter(table, lambda t: F.size(F.array_intersect(t["grams"], d)) >= t["least"]))
    mine = lambda t: F.filter(some, lambda g: F.array_contains(t["grams"], g["gram"]))
    each = lambda t: let(mine(t), lambda own: F.flatten(F.transform(_begins(t, own), lambda x: _windows(t, own, x, grams, threshold, most))))
    first = lambda every: F.filter(every, lambda m, k: (k == 0) | (F.get(every, k - 1)["first"] != m["first"]))
    order = lambda m: F.struct(m["minus_shared"], m["minus_dice"], m["license"], m["template_no"], m["first"], m["last"])
    around = lambda single, k: F.slice(single, F.greatest(k + 1 - most, F.lit(1)), F.lit(2 * most))  # noqa: E731  a window has no more than `most` words
    better = lambda single, m, k: F.exists(around(single, k), lambda o: (o["first"] <= m["last"]) & (o["last"] >= m["first"]) & (order(o) < order(m)))
    peaks = lambda single: F.filter(single, lambda m, k: ~better(single, m, k))
    return let(F.array_sort(F.flatten(F.transform(near, each))), lambda every: let(first(every), peaks))


def _begins(t: Column, own: Column) -> Column:
    """The bigrams a window of template t can begin at: the first of a stretch of its bigrams, with enough of them to follow within the window."""
    numbered = F.transform(own, lambda g, k: F.struct(g.alias("g"), k.alias("k")))
    new = lambda x: (x["k"] == 0) | (F.get(own, x["k"] - 1)["place"] != x["g"]["place"] - 1)
    follows = lambda x: F.get(own, x["k"] + t["least"] - 1)["place"]
    return F.filter(numbered, lambda x: new(x) & F.coalesce(follows(x) - x["g"]["place"] + 2 <= t["most"], F.lit(False)))


def _windows(t: Column, own: Column, x: Column, grams: Column, threshold: float, most: int) -> Column:
    """Of the windows that begin at x, those that match template t."""

    def matching(inside: Column) -> Column:
        after = lambda k: F.get(inside, k + 1)["place"]
        ends = F.filter(inside, lambda g, k: F.coalesce(after(k) != g["place"] + 1, F.lit(True)))  # the last of their stretch, or of what the window can hold
        shared = lambda e: F.size(F.array_distinct(F.transform(F.filter(inside, lambda g: g["place"] <= e["place"]), lambda g: g["gram"])))
        size = lambda e: F.size(F.array_distinct(F.transform(F.slice(grams, x["g"]["place"], e["place"] - x["g"]["place"] + 1), lambda g: g["gram"])))
        counted = F.filter(F.transform(ends, lambda e: F.struct(e.alias("e"), shared(e).alias("shared"))), lambda c: c["shared"] >= t["least"])
        scored = F.transform(counted, lambda c: F.struct(c["e"].alias("e"), c["shared"].alias("shared"), (2 * c["shared"] / (size(c["e"]) + t["size"])).alias("dice")))
        rank = lambda c: F.struct((x["g"]["place"] - 1).alias("first"), (-c["shared"]).alias("minus_shared"), (-c["dice"]).alias("minus_dice"), t["license"].alias("license"), t["template_no"].alias("template_no"), c["e"]["place"].alias("last"))
        return F.transform(F.filter(scored, lambda c: c["dice"] >= threshold), rank)

    return let(F.filter(F.slice(own, x["k"] + 1, F.lit(most)), lambda g: g["place"] - x["g"]["place"] + 2 <= t["most"]), matching)


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The scan in DuckDB's SQL: every window that begins at a bigram of a template against that template."""
    rows = ", ".join(f"('{n}', {i}, {len(g)}, {least_shared(len(g), threshold)}, {most_words(len(g), threshold)}, [{', '.join(repr(x) for x in g)}])" for n, i, g in templates())
    return f"""
WITH t(license, template_no, size, least, most, grams) AS (VALUES {rows}),
tg AS (SELECT license, template_no, size, least, most, unnest(grams) AS gram FROM t),
split AS (SELECT row_number() OVER () AS id, doc_id, string_split(trim(regexp_replace(lower(text), '{GAP}', ' ', 'g')), ' ') AS words FROM documents WHERE text IS NOT NULL),
gram AS (SELECT id, place, words[place] || ' ' || words[place + 1] AS gram FROM (SELECT id, words, unnest(range(1, len(words))) AS place FROM split)),
mine AS (SELECT g.*, license, template_no, size, least, most FROM gram g JOIN tg USING (gram)),
near AS (SELECT id, license, template_no FROM mine GROUP BY ALL HAVING count(DISTINCT gram) >= min(least)),
own AS (SELECT m.*, lag(place) OVER w IS DISTINCT FROM place - 1 AS opens, lead(place) OVER w IS DISTINCT FROM place + 1 AS closes FROM mine m SEMI JOIN near n ON m.id = n.id AND m.license = n.license AND m.template_no = n.template_no
  WINDOW w AS (PARTITION BY m.id, m.license, m.template_no ORDER BY place)),
ends AS (SELECT b.id, b.license, b.template_no, b.size, b.least, b.place AS first, e.place AS last FROM own b JOIN own e ON e.id = b.id AND e.license = b.license AND e.template_no = b.template_no
  AND e.place >= b.place AND e.place - b.place + 2 <= b.most AND (e.closes OR e.place - b.place + 2 = b.most) WHERE b.opens),
shared AS (SELECT s.*, count(DISTINCT g.gram) AS shared FROM ends s JOIN own g ON g.id = s.id AND g.license = s.license AND g.template_no = s.template_no AND g.place BETWEEN s.first AND s.last
  GROUP BY ALL HAVING count(DISTINCT g.gram) >= s.least),
scored AS (SELECT s.id, first - 1 AS first, last, license, template_no, shared, 2 * shared / (count(DISTINCT g.gram) + size) AS dice
  FROM shared s JOIN gram g ON g.id = s.id AND g.place BETWEEN s.first AND s.last GROUP BY s.id, first, last, license, template_no, shared, size),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id, first ORDER BY shared DESC, dice DESC, license, template_no, last) AS place FROM scored WHERE dice >= {threshold}),
single AS (SELECT * FROM ranked WHERE place = 1)
SELECT c.doc_id, CAST(m.first AS INT) AS first_word, CAST(m.last AS INT) AS last_word, m.license, m.template_no, CAST(m.shared AS INT) AS shared, round(m.dice, 6) AS dice FROM single m JOIN split c ON c.id = m.id
WHERE NOT EXISTS (SELECT 1 FROM single o WHERE o.id = m.id AND o.first <= m.last AND o.last >= m.first
  AND (-o.shared, -o.dice, o.license, o.template_no, o.first, o.last) < (-m.shared, -m.dice, m.license, m.template_no, m.first, m.last))"""
