"""Licence scans by canonical digest lookup.

A text is normalised (copyright lines dropped, lower case, equivalent spellings, punctuation and white space to single spaces)
and hashed with SHA-256; the digest is equi-joined with those of the known licence texts and notices. Entire
documents are looked up, and every line of a document as a text of its own, which is how short notices occur. The known
table is fixed in this module or given by the caller, and both sides are normalised by the same expressions.

The fixed table holds the public texts in ``license_texts`` (Apache-2.0, GPL-2.0 and 3.0, LGPL-2.1 and 3.0, MPL-1.1 and 2.0, CC0-1.0,
Artistic-1.0-Perl, GFDL-1.3; also up to their end of terms, without the appendix), MIT, ISC, BSD-2-Clause, BSD-3-Clause, Zlib, 0BSD, Unlicense
and WTFPL texts, the customary headers of source files, and one-line notices. AGPL-3.0 and the CC-BY licences are known by notices and
headers only. Lines of copyright and of reserved rights are dropped from both sides.
"All rights reserved." is a notice of its own (``Proprietary``) where nothing else in the document is known.

Edge cases: null and empty texts, and those with nothing left after normalising, match nothing; a notice repeated in a
document is counted; equal digests of several known texts give a row for each licence; rows of equal or null doc_id are looked up one by one;
a very long text is normalised whole if its first line can begin a known text; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

# Public licence texts and customary notices.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_END = _BSD2[_BSD2.index("THIS SOFTWARE") :]
_BSD3 = _BSD2.replace(_BSD_END, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END)
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
""" + _ISC[_ISC.index("THE SOFTWARE IS") :]
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_MORE = "\nFor more information, please refer to <{}://unlicense.org{}>"
_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
{}://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU_HEADER = """{what} is free software{sign} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{by} version {n}{later}.
{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with this {kind}. If not, see <{http}://www.gnu.org/licenses/>."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."""
_TITLES = {
    "MIT": ("", "MIT License\n", "The MIT License\n", "The MIT License (MIT)\n"), "ISC": ("", "ISC License\n", "The ISC License\n"), "0BSD": ("", "BSD Zero Clause License\n", "Zero-Clause BSD\n"),
    "BSD-2-Clause": ("", "BSD 2-Clause License\n", "The BSD 2-Clause License\n", 'BSD 2-Clause "Simplified" License\n'), "BSD-3-Clause": ("", "BSD 3-Clause License\n", "The BSD 3-Clause License\n", 'BSD 3-Clause "New" or "Revised" License\n'), "Zlib": ("", "zlib License\n"),
}
_BODIES = {"MIT": _MIT_GRANT, "ISC": _ISC, "0BSD": _0BSD, "BSD-2-Clause": _BSD2, "BSD-3-Clause": _BSD3, "Zlib": _ZLIB}
_NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_GNU = (("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"))
TEXTS = Path(__file__).parent / "license_texts"


def known_licenses(folder: Path = TEXTS) -> tuple[tuple[str, str], ...]:
    """(license_id, text) of every known text, header and notice; ``folder`` holds whole texts named by their ids."""
    out = [(i, title + body) for i, body in _BODIES.items() for title in _TITLES[i]] + list(_NOTICES)
    for file in sorted(folder.glob("*.txt")):
        text = file.read_text("utf-8")
        out.append((file.stem, text))
        if (end := text.find(mark := "END OF TERMS AND CONDITIONS")) >= 0:
            out += [(file.stem, text[:end]), (file.stem, text[: end + len(mark)])]
    for http in ("http", "https"):
        out += [("Apache-2.0", _APACHE_HEADER.format(http)), ("MPL-2.0", _MPL_HEADER.format(http)), ("Unlicense", _UNLICENSE + _UNLICENSE_MORE.format(http, "")), ("Unlicense", _UNLICENSE + _UNLICENSE_MORE.format(http, "/"))]
        for i, name, n in _GNU:
            for what, kind in (("This program", "program"), ("This library", "library"), ("This file", "file")):
                for sign, by, later in ((":", ", either", " of the License, or (at your option) any later version"), (";", "; either", " of the License, or (at your option) any later version"), (":", ",", " of the License")):
                    out.append((i, _GNU_HEADER.format(what=what, sign=sign, name=name, by=by, n=n, later=later, kind=kind, http=http)))
    return (*out, ("Unlicense", _UNLICENSE), ("WTFPL", _WTFPL))


KNOWN = known_licenses()
#: Fixed values: (spelling, its standard form), applied to whole words of the lower-cased text.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licences?", "license"), ("licenses", "license"), ("licenced", "licensed"), ("sub licen[cs]e", "sublicense"), ("sublicence", "sublicense"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"),
    ("copyright owners?", "copyright holder"), ("copyright holders", "copyright holder"), ("organisations?", "organization"), ("acknowledgements?", "acknowledgment"), ("favour", "favor"), ("ver", "version"), ("v", "version"),
)
#: A line that goes on with "copyright" in the middle of a sentence, as wrapped texts have it; it is marked and stays.
PROSE_LINE = r"(?m)^([ \t]*copyright[ \t]+(?:notices?|holders?|owners?|laws?|licen[cs]es?|interests?|statements?|disclaimers?|line|treat(?:y|ies)|permissions?|rights?|protections?|resulting|and|or|in|on|of|is|as|by|for|under|may|to|the software)\b)"
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright[ \t]+[^ \t\n][^\n]*|(?:\(c\)|©)[^\n]*[0-9]{4}[^\n]*)$"
RIGHTS_LINE = r"(?m)^[ \t]*all rights reserved[ \t.!]*$"
RIGHTS = "all rights reserved"


def _without_owners(low: Column) -> Column:
    """Lower-case text without its lines of copyright."""
    marked = low.contains("copyright") | low.contains("(c)") | low.contains("\u00a9")
    return F.when(marked, F.regexp_replace(F.regexp_replace(low, PROSE_LINE, "~$1"), COPYRIGHT_LINE, " ")).otherwise(low)


def _plain(text: Column) -> Column:
    """Lower case, lines of copyright and reserved rights gone, everything but letters and digits one space."""
    owned = _without_owners(F.lower(text))
    free = F.when(owned.contains(RIGHTS), F.regexp_replace(owned, RIGHTS_LINE, " ")).otherwise(owned)
    return F.trim(F.regexp_replace(free, "[^a-z0-9]+", " "))


def _spelled(plain: Column) -> Column:
    for spelling, standard in SPELLINGS:
        plain = F.regexp_replace(plain, rf"\b(?:{spelling})\b", standard)
    return plain


def normalise(text: Column) -> Column:
    return _spelled(_plain(text))


def oracle(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The same scan in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def norm(x: str) -> str:
        x = f"regexp_replace(regexp_replace(lower({x}), {quoted(PROSE_LINE)}, '~\\1', 'g'), {quoted(COPYRIGHT_LINE)}, ' ', 'g')"
        x = f"trim(regexp_replace(regexp_replace({x}, {quoted(RIGHTS_LINE)}, ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
        for spelling, standard in SPELLINGS:
            x = f"regexp_replace({x}, {quoted(rf'\b(?:{spelling})\b')}, {quoted(standard)}, 'g')"
        return x

    rows = ", ".join(f"({quoted(i)}, {quoted(b)})" for i, b in known)
    return f"""
WITH k AS (SELECT DISTINCT license_id, sha256({norm('body')}) AS digest FROM (VALUES {rows}) v(license_id, body)),
d AS (SELECT doc_id, row_number() OVER () AS r, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, r, unnest(string_split(text, chr(10))) AS body FROM d),
u AS (SELECT doc_id, r, 'text' AS unit, {norm('text')} AS key FROM d UNION ALL SELECT doc_id, r, 'line', {norm('body')} FROM l),
f AS (SELECT doc_id, r, license_id, unit, count(*) AS n FROM u JOIN k ON sha256(u.key) = digest WHERE u.key <> '' GROUP BY ALL)
SELECT doc_id, license_id, unit, n FROM f
UNION ALL SELECT doc_id, 'Proprietary', 'line', count(*) FROM l WHERE regexp_matches(lower(body), {quoted(RIGHTS_LINE)}) AND r NOT IN (SELECT r FROM f) GROUP BY doc_id, r
"""


def scan_licenses(documents: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(doc_id, license_id, unit, n): unit ``text`` if the entire document is the known text, ``line`` for n lines that are.

    Normalising and digests run on what can still match: lines, and texts whose first line with a letter or digit (lines of
    copyright and rights aside), begin with the first word of a known text. That word is compared before and after the spelling rules,
    so nothing that would match is left out.
    """
    spark = documents.sparkSession
    listed = spark.createDataFrame(list(known), "license_id string, body string")
    # the known table is fixed: a few hundred rows
    keys = listed.select("license_id", normalise(F.col("body")).alias("key")).filter("key <> ''").distinct()
    starts = sorted({r[0] for r in keys.select(F.split_part("key", F.lit(" "), F.lit(1))).collect()})
    begins = "^[^a-z0-9]*(?:" + "|".join([*starts, *{s.split()[0] for s, _ in SPELLINGS}]) + ")(?:[^a-z0-9]|$)"
    notice = F.array(F.struct(F.lit("Proprietary").alias("license_id"), F.lit(RIGHTS).alias("digest")))
    keys = F.broadcast(keys.select("license_id", F.sha2("key", 256).alias("digest")).unionByName(spark.range(1).select(F.inline(notice))))
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", F.monotonically_increasing_id().alias("row"), F.lower("text").alias("low"), F.split(F.lower("text"), "\n", -1).alias("lines"))
    line = lambda x: F.struct(F.lit("line").alias("unit"), x.alias("body"))
    rights = lambda x: x.contains(RIGHTS) & x.rlike(RIGHTS_LINE)
    first = F.get(F.filter(F.col("lines"), lambda x: x.rlike("[a-z0-9]") & ~rights(x) & (~(x.contains("copyright") | x.contains("(c)") | x.contains("\u00a9")) | _without_owners(x).rlike("[a-z0-9]"))), F.lit(0))
    whole = F.filter(F.array(F.struct(F.lit("text").alias("unit"), F.col("low").alias("body"))), lambda u: first.rlike(begins))
    units = texts.select("doc_id", "row", F.explode(F.concat(whole, F.transform(F.filter("lines", lambda x: x.rlike(begins) | rights(x)), line))).alias("u"))
    reserved = (F.col("unit") == "line") & rights(F.col("body"))
    digest = F.when(reserved, F.lit(RIGHTS)).otherwise(F.sha2(normalise(F.col("body")), 256))
    found = units.select("doc_id", "row", "u.unit", "u.body").select("doc_id", "row", "unit", digest.alias("digest")).join(keys, "digest")
    every = found.groupBy("doc_id", "row", "license_id", "unit").agg(F.count(F.lit(1)).alias("n"))
    known_too = F.max(F.col("license_id") != "Proprietary").over(Window.partitionBy("row"))
    return every.withColumn("known", known_too).filter((F.col("license_id") != "Proprietary") | ~F.col("known")).select("doc_id", "license_id", "unit", "n")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
