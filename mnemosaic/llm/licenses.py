"""License scans by canonical digest lookup, in DataFrame operations only.

A unit of text is made canonical: lower case, copyright lines gone, equivalent spellings made one,
everything but letters and digits one space. Its SHA-256 is joined to the digests of known notices and
texts, made canonical by the same expression. Units are the whole document, each of its lines, and each
run of paragraphs that is as long as a known text, so that the text of a licence is found at the head of a file too.
Paragraphs are parted by lines without letters and digits, so comment signs don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: SPDX identifiers and the names they go by.
LICENSES = {
    "0BSD": ["BSD Zero Clause License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL v3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License", "Apache License 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "BSL-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal License"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "EPL-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL v2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL v3", "GPL-3.0"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL v3", "LGPL-3.0"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "Zlib": ["zlib License"],
}
#: Sentences that name a licence.
NOTICES = (
    "Licensed under {}", "Licensed under the {}", "Licensed under the terms of the {}", "Released under {}", "Released under the {}",
    "Distributed under {}", "Distributed under the {}", "Available under the {}", "Published under the {} license",
    "This work is licensed under {}", "This work is licensed under a {}", "This work is licensed under the {}", "This project is licensed under the {}",
    "This project is licensed under the terms of the {}", "This software is released under the {}", "This program is licensed under the {}",
    "License: {}", "SPDX-License-Identifier: {}",
)
_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_WAIVE = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_NOTICE = "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_REDISTRIBUTE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "This notice may not be removed or altered from any source distribution.",
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
    "For more information, please refer to <https://unlicense.org/>"
)
_BOOST = (
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
    "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
    "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."


def _gnu(name: str, version: str) -> str:
    """The notice that files under a licence of this family have."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


def _listed(*items: str) -> list[str]:
    """The items in a row: numbered from one, from zero, or with signs that canonical form drops."""
    return [" ".join(f"{i + first}. {x}" for i, x in enumerate(items)) for first in (0, 1)] + [" ".join(items)]


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text): whole texts and the notices of files, each also under its names as a title."""
    bodies = [
        ("MIT", f"{_GRANT}, {_NOTICE} {_AS_IS}"),
        ("ISC", f"{_PERMIT}, provided that the above copyright notice and this permission notice appear in all copies. {_WAIVE}"),
        ("0BSD", f"{_PERMIT}. {_WAIVE}"),
        *[("BSD-2-Clause", f"{_REDISTRIBUTE} {x} {_BSD}") for x in _listed(_SOURCE, _BINARY)],
        *[("BSD-3-Clause", f"{_REDISTRIBUTE} {x} {_BSD}") for x in _listed(_SOURCE, _BINARY, _ENDORSE)],
        *[("Zlib", f"{_ZLIB[0]} {x}") for x in _listed(*_ZLIB[1:])],
        ("Unlicense", _UNLICENSE),
        ("BSL-1.0", _BOOST),
        ("Apache-2.0", _APACHE),
        ("MPL-2.0", _MPL),
        ("GPL-2.0", _gnu("GNU General Public License", "2")),
        ("GPL-3.0", _gnu("GNU General Public License", "3")),
        ("AGPL-3.0", _gnu("GNU Affero General Public License", "3")),
        ("LGPL-2.1", _gnu("GNU Lesser General Public License", "2.1")),
        ("LGPL-3.0", _gnu("GNU Lesser General Public License", "3")),
    ]
    return [(i, f"{title} {text}".strip()) for i, text in bodies for title in ("", *LICENSES[i], f"The {LICENSES[i][0]} ({i})", f"{LICENSES[i][0]} ({i})")]


#: Spellings that count as one.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("noncommercial", "non commercial"), ("sharealike", "share alike"), ("noderivatives", "no derivatives"), ("organisation", "organization"), ("favour", "favor"), ("and/or", "and or"), ("copyright owner", "copyright holder"), ("all rights reserved", ""), ("(mit)", "mit"), ("&", " and "), ("https:", "http:"))
COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by )|\(c\)|©)[^\n]*"
GAP = r"\n[^\p{L}\p{N}\n]*\n"
VERSION = r"\bv(ersion)?[. ]*([0-9])"
ARTICLES = r"\b(the|a) "
#: Every canonical known text has one of these words, which canonical form doesn't make: a unit without them matches none.
WORDS = r"(?i)licen[cs]|software|released|distributed|available|published"


def known_texts() -> list[tuple[str, str]]:
    made = {(i, n.format(name)) for i, names in LICENSES.items() for name in [*names, i] for n in NOTICES}
    return sorted(made | set(whole_texts()))


def canonical(text: Column) -> Column:
    c = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    for odd, plain in SPELLINGS:
        c = F.replace(c, F.lit(odd), F.lit(plain))
    c = F.regexp_replace(c, VERSION, " version $2")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), ARTICLES, ""))


def known_digests(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(digest, license, size): one row per canonical text, of the fixed table and of more(license, text)."""
    rows = spark.createDataFrame(known_texts(), "license string, text string")
    rows = rows if more is None else rows.union(more.select("license", "text").filter("text IS NOT NULL"))
    canon = rows.select("license", canonical(F.col("text")).alias("c")).filter("c <> ''")
    return canon.select(F.sha2("c", 256).alias("digest"), "license", F.length("c").alias("size")).groupBy("digest", "size").agg(F.min("license").alias("license"))


#: Paragraphs whose ends are added up at once, and lengths of known texts that are named in a filter.
STEP, LENGTHS = 1_000, 10_000


def _ends(parts: Column) -> Column:
    """Where each of an array of strings ends in their join by one character: running sums by groups of STEP."""
    sums = lambda xs, first: F.aggregate(xs, F.array(first), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))
    sizes = F.transform(parts, lambda x: F.length(x) + 1)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / STEP).cast("int")), lambda g: F.slice(sizes, g * STEP + 1, F.lit(STEP)))
    before = sums(F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda s, x: s + x)), F.lit(0))
    placed = F.zip_with(groups, before, lambda g, b: F.slice(sums(F.coalesce(g, F.array().cast("array<int>")), b), F.lit(2), F.size(F.coalesce(g, F.array().cast("array<int>")))))
    return F.transform(F.flatten(placed), lambda e: e - 1)


def _units(text: Column, known, most: int, likely) -> Column:
    """array<struct<kind, digest>>: the whole text, its likely lines, and every run of paragraphs that is as long as a known text.

    known says of a length whether a known text has it, and most is the largest: runs of any number of paragraphs are tried, up to that length.
    """
    unit = lambda kind, canon: F.struct(F.lit(kind).alias("kind"), F.sha2(canon, 256).alias("digest"))
    fits = lambda c: known(F.length(c))
    lines = F.filter(F.transform(F.filter(F.split(text, "\n"), likely), canonical), fits)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  computed once

    def runs(parts: Column, ends: Column) -> Column:
        first = lambda i: F.get(ends, i) - F.length(F.get(parts, i))
        some = lambda i: F.filter(F.slice(ends, i + 1, F.lit(most // 2 + 1)), lambda e: (e - first(i) <= most) & known(e - first(i)))  # noqa: E731  a paragraph and its gap have two characters at least
        of = lambda i: F.transform(some(i), lambda e: unit("block", F.array_join(F.slice(parts, i + 1, F.array_position(ends, e).cast("int") - i), " ")))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), of))

    none = F.array().cast("array<struct<kind:string,digest:string>>")
    parts = F.filter(F.transform(F.split(text, GAP), canonical), lambda x: x != "")
    blocks = F.when(text.rlike(GAP), let(parts, lambda p: F.when(F.size(p) > 0, let(_ends(p), lambda e: runs(p, e))).otherwise(none))).otherwise(none)
    whole = F.transform(F.filter(F.array(canonical(text)), fits), lambda c: unit("whole", c))
    return F.when(likely(text), F.concat(whole, F.transform(lines, lambda c: unit("line", c)), blocks)).otherwise(none)


def license_scan(docs: DataFrame, scratch: Scratch, more: DataFrame | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, whole_license, licenses, n_lines, n_blocks. more(license, text) are further known texts, of any length.

    whole_license is the licence whose text the document is; licenses are all those that the document, a line or a run of
    paragraphs of it states, sorted and comma-joined; n_lines and n_blocks count such lines and runs. Results are by row: rows that
    repeat a doc_id, or have none, keep their own. Null and empty texts state none; null texts of more are none, null licences are
    left out of lists. Other columns are not read; an empty table gives an empty one.

    Rows are written with a number and the digests of their units, which are few; texts are neither written nor shuffled.
    """
    known = known_digests(docs.sparkSession, more)
    sizes = [r[0] for r in known.select("size").distinct().limit(LENGTHS + 1).collect()]
    most = known.agg(F.max("size")).first()[0]
    fits = (lambda n: F.array_contains(F.array(*[F.lit(x) for x in sorted(sizes)]), n)) if len(sizes) <= LENGTHS else (lambda n: n <= most)
    likely = (lambda x: x.rlike(WORDS)) if more is None else (lambda x: x != "")  # further texts may have none of the words
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.monotonically_increasing_id().alias("row"), _units(F.col("text"), fits, most, likely).alias("units"))
    rows = scratch.keep(rows)
    units = rows.filter(F.size("units") > 0).select("row", F.explode("units").alias("u")).select("row", "u.kind", "u.digest")
    found = units.join(F.broadcast(known) if more is None else known, "digest")  # the fixed table has under a thousand rows
    stated = found.groupBy("row").agg(
        F.min(F.when(F.col("kind") == "whole", F.col("license"))).alias("whole_license"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        F.count_if(F.col("kind") == "line").alias("n_lines"),
        F.count_if(F.col("kind") == "block").alias("n_blocks"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", "row").join(stated, "row", "left").select("doc_id", "whole_license", F.coalesce("licenses", F.lit("")).alias("licenses"), zero("n_lines"), zero("n_blocks"))


def _sql_canonical(x: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    c = f"regexp_replace(lower({x}), {q(COPYRIGHT)}, ' ', 'g')"
    for odd, plain in SPELLINGS:
        c = f"replace({c}, {q(odd)}, {q(plain)})"
    c = f"regexp_replace({c}, {q(VERSION)}, ' version \\2', 'g')"
    c = f"regexp_replace({c}, {q(r'[^\p{L}\p{N}]+')}, ' ', 'g')"
    return f"trim(regexp_replace(' ' || {c} || ' ', {q(ARTICLES)}, '', 'g'))"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known_texts())
    return f"""
WITH raw(license, text) AS (VALUES {values}),
known AS (SELECT {_sql_canonical('text')} AS canon, min(license) AS license FROM raw GROUP BY 1),
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
most AS (SELECT max(length(canon)) AS n FROM known),
lists AS (
  SELECT row, list_filter(list_transform(string_split_regex(text, '{GAP}'), lambda p: {_sql_canonical('p')}), lambda p: p <> '') AS parts
  FROM docs WHERE regexp_matches(text, '{GAP}')),
places AS (SELECT row, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM lists),
ends AS (SELECT row, part, pos, sum(length(part) + 1) OVER (PARTITION BY row ORDER BY pos) AS e FROM places),
runs AS (SELECT a.row, a.pos, b.pos - a.pos + 1 AS n FROM ends a JOIN ends b ON a.row = b.row AND b.pos >= a.pos AND b.e - a.e + length(a.part) <= (SELECT n FROM most)),
units AS (
  SELECT row, 'line' AS kind, {_sql_canonical('unit')} AS canon FROM (SELECT row, unnest(string_split(text, chr(10))) AS unit FROM docs)
  UNION ALL SELECT row, 'whole', {_sql_canonical('text')} FROM docs
  UNION ALL SELECT row, 'block', array_to_string(parts[pos:pos + n - 1], ' ') FROM runs JOIN lists USING (row)),
found AS (SELECT u.row, u.kind, k.license FROM units u JOIN known k USING (canon)),
stated AS (
  SELECT row, min(CASE WHEN kind = 'whole' THEN license END) AS whole_license, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
         count(*) FILTER (WHERE kind = 'line') AS n_lines, count(*) FILTER (WHERE kind = 'block') AS n_blocks
  FROM found GROUP BY row)
SELECT d.doc_id, s.whole_license, coalesce(s.licenses, '') AS licenses, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_blocks, 0) AS n_blocks
FROM docs d LEFT JOIN stated s USING (row)
"""
