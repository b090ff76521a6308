"""License scan by canonical digests; DataFrame functions only.

A text is made canonical: lower case, copyright and rights lines removed,
punctuation and white space to single spaces, equivalent spellings unified.
The SHA-256 of the whole canonical text is hash-joined to the digests of known
licence texts, made by the same expression.  The known side has a fixed number
of rows and is broadcast; nothing else moves.  A line that speaks of a licence
is a text of its own: ``notices`` names the known ones among a text's lines.

A copyright line starts with "copyright", "(c)" or the sign and states a year, a
second mark or a place for one; a wrapped sentence that happens to start with
"copyright notice" stays.  Known texts come with and without their titles.

Defined edge cases: a null text counts as empty; texts without any letter or
digit match nothing; ids may be null or repeat; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
    "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
    "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
    "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE_HEAD = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
    "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
    'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
    "governing permissions and limitations under the License."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
#: Full texts of public licences; fixed values.
KNOWN: dict[str, str] = {
    "MIT": _MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. " + _NO_WARRANTY,
    "MIT-0": _MIT_GRANT + ". " + _NO_WARRANTY,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. " + _BSD_TAIL,
    "Zlib": _ZLIB,
    "Unlicense": _UNLICENSE + " For more information, please refer to <https://unlicense.org>",
    "Apache-2.0-header": _APACHE_HEAD,
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at https://mozilla.org/MPL/2.0/.",
}
#: Titles under which the texts are found; fixed values.
TITLES: dict[str, list[str]] = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
#: Names and ids of licences in one-line notices; fixed values.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache 2.0"],
    "MIT": ["the MIT License", "MIT License", "MIT"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GPL-2.0 license", "GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GPL-3.0 license", "GPLv3"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC0-1.0": ["CC0 1.0"],
}
NOTICE_FORMS = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}."]
#: Digests of the canonical forms of long texts, as distributed with Debian; fixed values.
LONG: dict[str, str] = {
    "ab8af54f2f9814aba95e91bddc0a1ced58303f2a9669b3ee1f1add796525e138": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60": "GFDL-1.2",
    "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "b54749b0c07bbeabddbddff412032a998968c1b883e5519575573024b2f1c421": "MPL-1.1",
    "cdb5877b9b73b693216820ac5a0090510c6fd9df7c38876e551b865cce774ddd": "MPL-2.0",
}
#: Equivalent spellings; fixed values.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "acknowledgement": "acknowledgment",
    "analogue": "analog", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "centre": "center", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "grey": "gray", "initialise": "initialize", "judgement": "judgment", "labour": "labor", "modelling": "modeling",
    "non infringement": "noninfringement", "non commercial": "noncommercial", "optimise": "optimize", "organisation": "organization", "organise": "organize", "copyright owner": "copyright holder",
    "percent": "per cent", "practise": "practice", "programme": "program", "recognise": "recognize", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http",
}
#: A line of a copyright or rights notice; (?m) means lines that end with a line feed.
COPYRIGHT_LINE = r"^[ \t]*(?:copyright[^\n]*(?:[0-9]{4}|\(c\)|©|<year>|\[yyyy\]|\[year\])[^\n]*|(?:\(c\)|©)[^\n]*|all rights reserved\.?[ \t\r]*)$"
PUNCTUATION = r"[\x00-\x20!-/:-@\x5B-\x60{-\x7F\x{00A0}\x{00AB}\x{00BB}\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}\x{2022}]+"
#: What a line must hold, in lower case, to be looked up on its own.
CUE = "licen"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"(?md){COPYRIGHT_LINE}", " ")
    # two spaces between words, so that neighbouring words are replaced alike
    out = F.concat(F.lit("  "), F.regexp_replace(out, PUNCTUATION, "  "), F.lit("  "))
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(canonical(text), "UTF-8"), 256)


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text): each text alone, under each title, with and without numbers of clauses; notices in all forms."""
    out = set()
    for name, text in KNOWN.items():
        for body in {text, text.replace("1. ", "").replace("2. ", "").replace("3. ", "") if name.startswith(("BSD", "Zlib")) else text}:
            out |= {(name, body)} | {(name, f"{title} {body}") for title in TITLES.get(name, [])}
    for name, titles in NAMES.items():
        out |= {(f"{name}-notice", form.format(title)) for form in NOTICE_FORMS for title in titles}
        out.add((f"{name}-notice", f"SPDX-License-Identifier: {name}"))
    return sorted(out)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(canonical_sha256, license_id): one row of each digest."""
    texts = spark.createDataFrame(known or known_texts(), "license_id string, text string")
    digests = texts.select("license_id", digest(F.col("text")).alias("canonical_sha256"))
    if known is None:
        digests = digests.unionByName(spark.createDataFrame(sorted(LONG.items()), "canonical_sha256 string, license_id string"))
    return digests.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, canonical_sha256, license_id (null if unknown),
    is_license, notices (known ids of its lines, sorted, joined by commas; '' if none).

    ``known`` are (licence id, text) pairs instead of the built-in ones; they are
    literals of the plan, so they must be few, as licences are."""
    table = known_digests(docs.sparkSession, known)
    pairs = table.collect()  # as many as known texts, whatever the input
    ids = F.create_map(*[F.lit(x) for row in sorted(pairs) for x in row])
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.contains(F.lower(x), F.lit(CUE)))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(ids, digest(x))), lambda x: x.isNotNull())
    digests = docs.select(
        F.col(id_col).cast("long").alias(id_col), digest(F.col(text_col)).alias("canonical_sha256"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices")
    )
    # the known side is made of the collected rows
    out = digests.join(F.broadcast(table), "canonical_sha256", "left")
    return out.select(id_col, "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"), "notices")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '(?m){COPYRIGHT_LINE}', ' ', 'g')"
    out = f"'  ' || regexp_replace({out}, '{PUNCTUATION}', '  ', 'g') || '  '"
    spelt = reduce(lambda x, ab: f"replace({x}, ' {ab[0].replace(' ', '  ')} ', ' {ab[1].replace(' ', '  ')} ')", SPELLINGS.items(), out)
    return f"sha256(trim(regexp_replace({spelt}, ' +', ' ', 'g')))"


def _quoted(rows) -> str:
    return ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in rows)


OP3_SQL = f"""
WITH t AS (
  SELECT license_id, {_sql("t")} AS h FROM (VALUES {_quoted(known_texts())}) v(license_id, t)
  UNION ALL SELECT license_id, h FROM (VALUES {_quoted(sorted(LONG.items()))}) v(h, license_id)
), k AS (SELECT min(license_id) AS license_id, h FROM t GROUP BY h),
d AS (SELECT row_number() OVER () AS r, doc_id, text, {_sql("text")} AS h FROM documents),
l AS (SELECT r, {_sql("line")} AS h FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE contains(lower(line), '{CUE}')),
n AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM l JOIN k USING (h) GROUP BY r)
SELECT doc_id, d.h AS canonical_sha256, license_id, license_id IS NOT NULL AS is_license, coalesce(notices, '') AS notices
FROM d LEFT JOIN k USING (h) LEFT JOIN n USING (r)
"""
