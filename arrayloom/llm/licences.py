"""Licence scans by canonical digests, with DataFrame functions only.

A text is brought to a canonical form (lower case, no copyright and title lines, no list numbers, no punctuation,
one spelling of equivalent words and owners' names, single spaces) and its SHA-256 is hash-joined to the
digests of known licences. The canonical form keeps lines and blank lines until the end, so that beside the whole text
lines that begin like a known text are found, by a join on its first words, and as many words from there on are looked up as that text has: a licence inside a longer text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.llm.common import checkpointed, sized, unpacked

# Texts of public licences and of their usual notices.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]

# Names of licences as notices give them, and how notices begin. Every beginning goes with every name.
NAMES = [
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("Zlib", "zlib License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("EPL-2.0", "Eclipse Public License, version 2.0"), ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
]
BEGINNINGS = [f"{what}{how} under{the}" for what in ("", "This work is ", "This file is ", "This software is ", "This program is ", "This project is ") for how in ("licensed", "released", "distributed") for the in (" the", "")]
NOTICES = [(name, f"{beginning} {spelled}") for name, spelled in NAMES for beginning in BEGINNINGS]

# Long licences by the digests of their canonical forms: name, digest, words, first words.
LONG = [
    ("Apache-2.0", "27c31048f17322ffdab4768169d2637106379ca5d9ca0ed2f37849341bfb46da", 1561, "apache license version 2"),
    ("Artistic-1.0", "04ff4273deaa7f29afb6e32bd4694c7cf0dbf890c26b18302fef59ad10e44130", 950, "the artistic license preamble"),
    ("CC0-1.0", "adf75bc38a3fbbdcbadda90b262623acbb176db40d4de0538e4bddaa4c7f8d2a", 1083, "creative commons legal code"),
    ("GFDL-1.2", "1a5ccf39d661fc938d0ae55b65618e99700c8f105e2449a7f59a20a9cab27d95", 3294, "gnu free documentation license"),
    ("GFDL-1.3", "a35b3233795796fbfa3a4b4766e291102763ccd9b8bbe9bce0054c11bf3a0f7a", 3697, "gnu free documentation license"),
    ("GPL-1.0", "8006d6938e45108c7c95d49b6d84aa0a345eedc8566395dd2bc121b8e6ba4ae9", 2055, "gnu general public license"),
    ("GPL-2.0", "e372e8f404b755ffd91c838b6c40b268a8bd9702865fdcb58acf7a83b9e46b93", 2951, "gnu general public license"),
    ("GPL-3.0", "cd6779522e7cf1dce2e279bd46f8cc1626e02d3f3c352a4e9cc097e3001dfbf5", 5642, "gnu general public license"),
    ("LGPL-2.0", "3fef5fb4b6c6d5b36a8213009e49dbe351c37dcc63a7efb13a3c8f6ff217f345", 4148, "gnu library general public"),
    ("LGPL-2.1", "d51f08ef24d74b4376f4a8c4281de02f3ae6aa1c49c6840e60a997ce9bce5a38", 4349, "gnu lesser general public"),
    ("LGPL-3.0", "828c3944cde1fc14c68737c9be14d8d0f4f13ab980f8a72364a0e64f72965525", 1222, "gnu lesser general public"),
    ("MPL-1.1", "2ea0732d867e1249fc49cc01cb9c9c37a1c445d8dc15577e3871ec65f04f71e4", 3745, "mozilla public license version"),
    ("MPL-2.0", "32c6d656f15cd2ffee168f7e42b79233bc2e81584b17091840d449c48f044dd4", 2404, "mozilla public license version"),
]

# Equivalent spellings, by whole words of the canonical form; a blank there may be a line's end.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("recognise", "recognize"), ("per cent", "percent"), ("https", "http")]
# Where a licence names its owner.
OWNERS = [("neither the name of", "nor the names of"), ("software is provided by", "as is"), ("in no event shall", "be liable")]

#: Words that a line and the two after it begin with, by which known texts are found inside others.
ANCHOR = 4
#: Lines that only say who holds a copyright or which short licence follows, and numbers of lists.
DROPPED = r"(?m)^[ \t/*#;-]*((copyright|\(c\)|©)[^\n]*|all rights reserved\.?[ \t]*|(the )?((mit|isc|x11|expat|zlib|bsd|unlicense|boost software|simplified bsd|new bsd|modified bsd|bsd [0-9]-clause|[0-9]-clause bsd)[ -]?)+licen[cs]e( \([^)\n]*\))?( ?-? ?version [0-9.]+[^\n]*)?[ \t:]*)$"
NUMBERS = r"(?m)^([ \t/*#;-]*)\(?[0-9]{1,2}[.)][ \t]+"
PUNCTUATION = r"[\x00-\x09\x0b-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def _unix(pattern: str) -> str:
    """For Java, where only \\n is to end a line."""
    return pattern.replace("(?m)", "(?md)")


def canonical_lines(text: Column) -> Column:
    """The canonical form with its lines: no blanks at their ends, blank lines empty."""
    c = F.lower(text)
    # Most texts hold none of these words: each of the costlier rewrites runs only where it can change something.
    c = F.when(c.rlike(r"copyright|\(c\)|©|licen[cs]e|all rights"), F.regexp_replace(c, _unix(DROPPED), "")).otherwise(c)
    c = F.when(c.rlike(r"[0-9][.)][ \t]"), F.regexp_replace(c, _unix(NUMBERS), "$1")).otherwise(c)
    c = F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), PUNCTUATION, " ")
    c = F.when(c.contains("\n"), F.regexp_replace(F.replace(c, F.lit("\n "), F.lit("\n")), " \n", "\n")).otherwise(c)
    swapped = c
    for a, b in SPELLINGS:
        swapped = F.regexp_replace(swapped, rf"\b{a}\b".replace(" ", r"[ \n]+"), b)
    for a, b in OWNERS:
        swapped = F.regexp_replace(swapped, rf"\b{a} [^\x00-\x09]{{1,80}}? {b}\b".replace(" ", r"[ \n]+"), f"{a} owner {b}")
    may = "|".join([*(a.replace(" ", r"[ \n]+") for a, _ in SPELLINGS), *(a.replace(" ", r"[ \n]+") for a, _ in OWNERS)])
    return F.trim(F.when(c.rlike(may), swapped).otherwise(c), F.lit(" \n"))


def _flat(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, runs of ASCII punctuation and white space as one space, one spelling of equivalent words."""
    return _flat(canonical_lines(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _first(text: Column, n: Column) -> Column:
    """The first n words."""
    return F.call_function("substring_index", text, F.lit(" "), n)


def _filled(lines: Column) -> Column:
    return F.filter(F.transform(F.split(lines, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence, first, n) of known texts, (licence, text); one row a digest: its first words and the number of its words. Without a list: all that this module knows."""
    listed = spark.createDataFrame(known if known is not None else KNOWN + NOTICES, "licence string, text string")
    rows = listed.select("licence", canonical(F.col("text")).alias("c"))
    rows = rows.select(F.sha2("c", 256).alias("digest"), "licence", _first(F.col("c"), F.lit(ANCHOR)).alias("first"), F.size(F.split("c", " ")).alias("n"))
    if known is None:
        rows = rows.union(spark.createDataFrame([(d, name, first, n) for name, d, n, first in LONG], "digest string, licence string, first string, n int"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"), F.min("first").alias("first"), F.min("n").alias("n"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (None: all) and digest, licence (of the whole text, or null), notices (sorted names of the known texts inside, by comma, or null).

    known: what :func:`known_digests` gives. A known text stands inside if it begins with a line; where lines end in it doesn't matter.
    Null text: null digest and no match. An empty canonical form matches nothing unless a known
    text has it. Rows that repeat are looked up each. Empty table: empty result. New columns
    replace input columns of their names.
    """
    known = known if known is not None else known_digests(docs.sparkSession)
    columns = docs.columns if keep is None else keep
    whole = sized(known.select(F.col("digest").alias("__k"), F.col("licence").alias("__licence")), 200_000)
    firsts = sized(known.where(F.col("first") != "").groupBy("first").agg(F.collect_set("n").alias("__ns")), 200_000)
    # Every text is brought to its form once; what its lines begin with is kept beside its digest.
    rows = docs.select(F.struct(*(F.col(c) for c in columns)).alias("__row"), F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__mark"), canonical_lines(F.col(text_col)).alias("__lines"))
    rows = rows.select("__row", "__id", "__mark", F.sha2(_flat(F.col("__lines")), 256).alias("__digest"), _filled(F.col("__lines")).alias("__ls"))
    ahead = lambda i, k: F.get("__ls", i + k)
    begins = F.transform("__ls", lambda x, i: _first(F.concat_ws(" ", x, ahead(i, 1), ahead(i, 2)), F.lit(ANCHOR)))
    rows = checkpointed(rows.select("__row", "__id", "__mark", "__digest", begins.alias("__begins")))
    begun = rows.select("__id", "__mark", F.posexplode("__begins").alias("__at", "first")).join(firsts, "first")
    begun = checkpointed(begun.groupBy(F.col("__id").alias("__i"), F.col("__mark").alias("__m")).agg(F.collect_set(F.struct("__at", "__ns")).alias("__begun")))
    # The few texts that begin a known text somewhere are formed again.
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__fid"), F.xxhash64(text_col).alias("__fmark"), F.col(text_col).alias("__text"))
    told = texts.join(begun, F.col("__fid").eqNullSafe(F.col("__i")) & (F.col("__fmark") == F.col("__m"))).select("__fid", "__fmark", "__begun", _filled(canonical_lines(F.col("__text"))).alias("__ls"))
    # Lines aren't empty, so that n lines hold n words or more.
    run = lambda at, n: F.sha2(_first(F.array_join(F.slice("__ls", at + 1, n), " "), n), 256)
    digests = F.array_distinct(F.flatten(F.transform("__begun", lambda b: F.transform(b["__ns"], lambda n: run(b["__at"], n)))))
    found = told.select("__fid", "__fmark", F.explode(digests).alias("__d")).join(whole, F.col("__d") == F.col("__k"))
    found = found.groupBy("__fid", "__fmark").agg(F.array_join(F.array_sort(F.collect_set("__licence")), ",").alias("__notices"))
    out = rows.select("__row", "__id", "__mark", "__digest").join(whole, F.col("__digest") == F.col("__k"), "left")
    out = out.join(found, F.col("__id").eqNullSafe(F.col("__fid")) & (F.col("__mark") == F.col("__fmark")), "left")
    return unpacked(out, columns, digest=F.col("__digest"), licence=F.col("__licence"), notices=F.col("__notices"))


def _sql_lines(x: str) -> str:
    c = rf"regexp_replace(lower({x}), '{DROPPED}', '', 'g')"
    c = rf"regexp_replace({c}, '{NUMBERS}', '\1', 'g')"
    c = rf"regexp_replace(replace({c}, '&', ' and '), '{PUNCTUATION}', ' ', 'g')"
    c = f"replace(replace({c}, chr(10) || ' ', chr(10)), ' ' || chr(10), chr(10))"
    for a, b in SPELLINGS:
        c = rf"regexp_replace({c}, '{rf'\b{a}\b'.replace(' ', r'[ \n]+')}', '{b}', 'g')"
    for a, b in OWNERS:
        c = rf"regexp_replace({c}, '{rf'\b{a} [^\x00-\x09]{{1,80}}? {b}\b'.replace(' ', r'[ \n]+')}', '{a} owner {b}', 'g')"
    return f"trim({c}, ' ' || chr(10))"


def oracle() -> str:
    values = ", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in KNOWN + NOTICES)
    long = ", ".join(f"('{d}', '{name}', '{first}', {n})" for name, d, n, first in LONG)
    flat = lambda x: rf"trim(regexp_replace({x}, '[ \n]+', ' ', 'g'), ' ')"
    first = lambda x, n: f"array_to_string(string_split({x}, ' ')[1:{n}], ' ')"
    return rf"""
WITH t AS (SELECT l, {flat(_sql_lines('t'))} AS c FROM (VALUES {values}) v(l, t)),
k AS (SELECT dg, min(l) AS licence, min(first) AS first, min(n) AS n FROM (
  SELECT sha256(c) AS dg, l, {first('c', ANCHOR)} AS first, len(string_split(c, ' ')) AS n FROM t UNION ALL SELECT * FROM (VALUES {long}) w(dg, l, first, n)) GROUP BY dg),
d AS (SELECT doc_id, {_sql_lines('text')} AS c FROM documents),
w AS (SELECT doc_id, sha256({flat('c')}) AS digest FROM d),
p AS (SELECT doc_id, list_filter(list_transform(string_split(c, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM d),
y AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM p),
r AS (SELECT DISTINCT doc_id, sha256({first("array_to_string(ls[i : i + n - 1], ' ')", 'n')}) AS dg
      FROM y JOIN (SELECT DISTINCT first, n FROM k WHERE first <> '') f ON {first("concat_ws(' ', ls[i], ls[i + 1], ls[i + 2])", ANCHOR)} = f.first),
n AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM r JOIN k USING (dg) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.licence, n.notices FROM w LEFT JOIN k ON w.digest = k.dg LEFT JOIN n ON w.doc_id = n.doc_id
"""
