r"""Operator 8, licence scans: canonical digests of whole texts, looked up among those of known licences.

The canonical form is lower case without copyright lines and list numbers; spellings that licences use alike become one;
what is neither letter nor digit is a space; a title that is only the licence's name goes. Known texts are licence notices
(a line of a document) and whole licences (a document), a table that callers can extend. All is done by built-in functions.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licence notices, as they are commonly written.
NOTICES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
)
#: Licences whose machine-readable identifier line is known.
IDENTIFIERS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
#: Whole texts of short licences, without their copyright lines.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Copyright (C) 2004 Sam Hocevar

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
}
#: Of long licences' whole texts, the canonical digest and a word that each has.
DIGESTS: dict[str, tuple[str, str]] = {
    "Apache-2.0": ("f8917e53ed99f76b3dcbd010ed0b13fa", "provided"),
    "CC0-1.0": ("1a2ae468ccae8122ceca54319f482b81", "provided"),
    "GFDL-1.3": ("8f1cc64934805f69f21d61f38eebc7d9", "provided"),
    "GFDL-1.2": ("01ac3e7c929c24d7d1582e65d6da183a", "provided"),
    "GPL-1.0": ("756584a200d155cdfedb78fb537fd57b", "provided"),
    "GPL-2.0": ("4060e43251dec11a4fa5d05f6f68c537", "provided"),
    "GPL-3.0": ("313ed51df39f97da9997dccfa2afddd4", "provided"),
    "LGPL-2.0": ("26b620cb1c577f04e5598d5aa09e7a60", "provided"),
    "LGPL-2.1": ("f2c647ddf22a34f7f567ae6cefaf3bf6", "provided"),
    "LGPL-3.0": ("0dbc4783eda1bbc2f2e0f29b271f99a3", "provided"),
    "MPL-1.1": ("522a0efbf0da283eae1c47b112958d87", "provided"),
    "MPL-2.0": ("2b9e225e20c8882ab2645e6f231ea4ab", "provided"),
    "Artistic-1.0-Perl": ("81264bf53b2a22402365ec1e7b32b976", "provided"),
}
#: Spellings that count as equivalent, as patterns of the lower-case text; RE2 and Java read them alike.
SPELLINGS = (
    (r"licence", "license"),
    (r"licenc", "licens"),
    (r"sub-license", "sublicense"),
    (r"non-infringement", "noninfringement"),
    (r"acknowledgement", "acknowledgment"),
    (r"merchantibility", "merchantability"),
    (r"copyright owner", "copyright holder"),
    (r"favour", "favor"),
    (r"organis", "organiz"),
    (r"https?://", ""),
    (r"&", " and "),
)
#: A whole copyright line of the lower-case text, known by a year or mark, so that a line which a wrapped sentence begins isn't one.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/]*(?:copyright[ \t]*(?:\(c\)|©|\[|<|[0-9]{4})|(?:©|\(c\))[ \t]*(?:copyright[ \t]*)?(?:[0-9]{4}|\[|<)|all rights reserved)[^\n]*"
#: Numbers and bullets of lists.
BULLET = r"(^|\n)[ \t*#/]*(?:[0-9]{1,2}[.)]|\([a-z0-9]\)|[•*-])[ \t]+"
# Names that stand as titles above licences, in canonical form.
TITLES = (
    "the mit license mit", "the mit license", "mit license mit", "mit license", "mit no attribution", "the isc license", "isc license", "isc license isc",
    "the zlib license", "zlib license", "the bsd license", "bsd license", "bsd 2 clause license", "bsd 3 clause license", "the 2 clause bsd license",
    "the 3 clause bsd license", "bsd zero clause license", "zero clause bsd", "the unlicense",
)
TITLE = "^(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + ") "


#: Words that most known texts have; the fewer anchors there are, the faster is a scan.
COMMON = ("provided", "licensed")


@dataclass(frozen=True)
class Known:
    """A known text: its licence, scope (text or notice), canonical digest, and a pattern that its lower-case form has."""

    licence: str
    scope: str
    digest: str
    anchor: str


def plain_canonical(text: str) -> str:
    """The canonical form, by the same patterns as the columns use."""
    out = re.sub(COPYRIGHT_LINE, r"\1", text.lower())
    out = re.sub(BULLET, r"\1", out)
    for pattern, to in SPELLINGS:
        out = re.sub(pattern, to, out)
    return re.sub(TITLE, "", re.sub(r"[^a-z0-9]+", " ", out).strip())


def known_text(licence: str, scope: str, text: str) -> Known:
    """A row of the table of known texts. Its anchor is a word that many known texts have, or else its longest, in all spellings."""
    form = plain_canonical(text)
    words = form.split()
    word = next((w for w in COMMON if w in words), None) or max(words, key=len)
    for pattern, to in SPELLINGS:
        if to.strip() and re.fullmatch("[a-z]+", pattern):
            word = word.replace(to, f"(?:{pattern}|{to})") if "(" not in word else word
    return Known(licence, scope, hashlib.md5(form.encode()).hexdigest(), word)


def known() -> list[Known]:
    """The known texts of this module."""
    rows = [known_text(k, "notice", v) for k, v in NOTICES]
    rows += [known_text(k, "notice", f"SPDX-License-Identifier: {k}") for k in IDENTIFIERS]
    rows += [known_text(k, "text", v) for k, v in TEXTS.items()]
    return rows + [Known(k, "text", digest_, word) for k, (digest_, word) in DIGESTS.items()]


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1"), BULLET, "$1")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " ")), TITLE, "")


def digest(text: Column) -> Column:
    return F.md5(canonical(text))


def lookup(spark: SparkSession, table: list[Known]) -> DataFrame:
    return spark.createDataFrame([(k.licence, k.scope, k.digest) for k in table], "licence string, scope string, digest string").distinct()


def scan(docs: DataFrame, table: list[Known] | None = None) -> DataFrame:
    """One row for each document, licence and scope that match: doc_id, licence, scope, n_found.

    scope text: the whole document is that licence; notice: n_found of its lines are that notice. A document that is one
    line can be both. table (known() unless given) is a list, so of a size that a driver holds and can be broadcast. Only
    texts and lines with a known text's anchor are made canonical; no other can match.
    Null and empty texts match nothing; repeated rows are counted each; no rows give none; other columns are ignored.
    """
    table = known() if table is None else table
    has = lambda text, scope: F.regexp_like(F.lower(text), F.lit(_anchors(table, scope)))
    rows = docs.select("doc_id", "text").where("text is not null")
    likely = rows.where(has(F.col("text"), None))
    whole = likely.where(has(F.col("text"), "text")).select("doc_id", F.lit("text").alias("scope"), digest(F.col("text")).alias("digest"))
    lines = likely.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(has(F.col("line"), "notice"))
    units = whole.unionByName(lines.select("doc_id", F.lit("notice").alias("scope"), digest(F.col("line")).alias("digest")))
    found = units.join(F.broadcast(lookup(docs.sparkSession, table)), ["scope", "digest"])
    return found.groupBy("doc_id", "licence", "scope").agg(F.count("*").alias("n_found"))


def _anchors(table: list[Known], scope: str | None) -> str:
    """A pattern that every known text of that scope (None: of any) has; one that nothing has if there is none."""
    return "|".join(sorted({k.anchor for k in table if scope in (None, k.scope)})) or "[^\\s\\S]"


def oracle() -> str:
    """The same in DuckDB's SQL, without anchors."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def sql(text: str) -> str:
        out = f"regexp_replace(regexp_replace(lower({text}), {quoted(COPYRIGHT_LINE)}, '\\1', 'g'), {quoted(BULLET)}, '\\1', 'g')"
        for pattern, to in SPELLINGS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to)}, 'g')"
        return f"md5(regexp_replace(trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g')), {quoted(TITLE)}, ''))"

    rows = [(k, "notice", v) for k, v in NOTICES] + [(k, "notice", f"SPDX-License-Identifier: {k}") for k in IDENTIFIERS]
    rows += [(k, "text", v) for k, v in TEXTS.items()]
    values = ", ".join(f"({quoted(k)}, {quoted(s)}, {quoted(v)})" for k, s, v in rows)
    long = ", ".join(f"({quoted(k)}, 'text', {quoted(d)})" for k, (d, _) in DIGESTS.items())
    return f"""
WITH known AS (SELECT DISTINCT licence, scope, {sql('body')} AS digest FROM (VALUES {values}) v(licence, scope, body)
  UNION ALL SELECT * FROM (VALUES {long}) l(licence, scope, digest)),
units AS (
  SELECT doc_id, 'text' AS scope, {sql('text')} AS digest FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, 'notice', {sql('line')} FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL))
SELECT doc_id, licence, scope, count(*) AS n_found FROM units JOIN known USING (scope, digest)
GROUP BY doc_id, licence, scope
"""
