"""Licence scan by canonical digest lookup.

A text is brought to a canonical form (lower case, no copyright lines, one spelling for equivalent
words, letters and digits only, single spaces) and its SHA-256 digest is hash-joined to the digests of
known licence texts. Whole documents are looked up by the join; single lines that mention a licence
are looked up the same way among known notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small

#: Equivalent spellings, as (found, canonical), in this order.
SPELLINGS = (
    ("licence", "license"),
    ("licencing", "licensing"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("merchantibility", "merchantability"),
    ("modernise", "modernize"),
    ("organisation", "organization"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("wilful", "willful"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    (" https ", " http "),
)

#: A line that is only a copyright statement, after any comment marks.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;%!.-]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"

#: The same for lower-cased text, but only with what makes a statement, so a wrapped clause of a licence that begins with these words stays:
#: a mark, a year, "by" or a name after "copyright"; a year or "copyright" after "(c)".
STATEMENT_LINE = (
    r"(?m)^[ \t*#/;%!.-]*(?:copyright[ \t]*(?::|,|\(c\)|©|&copy;|[0-9]{4}\b|by\b)|copyright[ \t]+(?!(?:holders?|owners?|notices?|laws?|licen[sc]es?|statements?|"
    r"interests?|rights?|treaty|treaties|protection|and|or|in|is|are|be|as|to|of|the|on|for|which|that|may|shall|will|if|with|under)\b)\p{L}|\(c\)[ \t]*(?:copyright\b|[0-9]{4}\b)|©|all rights reserved)[^\n]*$"
)

#: Lines that can be a notice mention one of these.
NOTICE_CUE = r"(?i)licen[sc]e|spdx|public domain"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_KEEP = """, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Known whole texts: (licence id, text). A caller may pass a longer catalogue as a DataFrame.
LICENCE_TEXTS = (
    ("MIT", _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC_GRANT + _ISC_KEEP + _ISC_END),
    ("ISC", "ISC License\n" + _ISC_GRANT + _ISC_KEEP + _ISC_END),
    ("0BSD", _ISC_GRANT + "." + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("Zlib", _ZLIB),
)

#: SHA-256 of the canonical form of longer licences, as Linux distributions ship their texts (licence id, digest). They follow
#: from canonical(); a change of it needs new ones, which a test shows where the texts are installed.
LICENCE_DIGESTS = (
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    ("GPL-2.0", "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    ("GPL-3.0", "5e06bcb7b8c914d3ffb433229937b503a624ae6c7bb9ac1cad01e35a324bcb6d"),
    ("LGPL-2.0", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.1", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
)

#: Known one-line notices: (licence id, line).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, STATEMENT_LINE, "")
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for found, kept in SPELLINGS:
        t = F.replace(t, F.lit(found), F.lit(kept))
    return F.trim(F.regexp_replace(t, " {2,}", " "))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(canonical(text), "UTF-8"), 256)


def _catalogue(spark: SparkSession, rows: tuple[tuple[str, str], ...]) -> DataFrame:
    return spark.createDataFrame(list(rows), "licence_id string, licence_text string")


def digests(catalogue: DataFrame) -> DataFrame:
    """(known_digest, licence_id): one row for each digest, the smallest id where several share one."""
    return catalogue.groupBy(digest(F.col("licence_text")).alias("known_digest")).agg(F.min("licence_id").alias("licence_id"))


def scan_licences(docs: DataFrame, catalogue: DataFrame | None = None, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """docs (text and any others) with licence_digest, licence_id and notice_ids.

    licence_id: the known licence whose canonical text equals the whole document's, else null; a document
    that is empty after normalisation has none. notice_ids: array, sorted and distinct, of the licences
    whose notice is a whole line of the document; empty for none or null text. notices is a short list
    and stands in the plan; the catalogue is broadcast only if its counted size allows. Rows are kept
    one for one; input columns of these three names are replaced.
    """
    spark = docs.sparkSession
    if catalogue is not None:
        known = digests(catalogue)
    else:
        listed = spark.createDataFrame(list(LICENCE_DIGESTS), "licence_id string, known_digest string").select("known_digest", "licence_id")
        known = digests(_catalogue(spark, LICENCE_TEXTS)).unionByName(listed).groupBy("known_digest").agg(F.min("licence_id").alias("licence_id"))
    lines = _catalogue(spark, notices)
    table = {r[0]: r[1] for r in digests(lines).collect()}  # as long as the parameter
    pairs = [F.lit(x) for kv in sorted(table.items()) for x in kv]
    cued = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit(NOTICE_CUE)))
    ids = F.transform(cued, lambda x: F.try_element_at(F.create_map(*pairs), digest(x)))
    found = F.when(F.regexp_like("text", F.lit(NOTICE_CUE)), F.array_sort(F.array_distinct(F.array_compact(ids)))).otherwise(F.array().cast("array<string>"))
    out = docs.drop("licence_id").withColumns({"licence_digest": digest(F.col("text")), "notice_ids": found})
    return out.join(small(known.withColumnRenamed("known_digest", "licence_digest"), 200), "licence_digest", "left").select(*out.columns, "licence_id")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licences(docs).select("doc_id", "licence_digest", "licence_id", F.array_join("notice_ids", ",").alias("notice_ids"))


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql() -> str:
    def form(x: str) -> str:
        t = f"regexp_replace(lower(coalesce({x}, '')), {_quote(COPYRIGHT_LINE)}, '', 'g')"
        t = f"' ' || regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
        for a, b in SPELLINGS:
            t = f"replace({t}, {_quote(a)}, {_quote(b)})"
        return f"sha256(trim(regexp_replace({t}, ' {{2,}}', ' ', 'g')))"

    values = lambda rows: ", ".join(f"({_quote(a)}, {_quote(b)})" for a, b in rows)
    return f"""
WITH known AS (SELECT {form("t")} AS d, min(id) AS licence_id FROM (VALUES {values(LICENCE_TEXTS)}) AS v(id, t) GROUP BY 1),
notice AS (SELECT {form("t")} AS d, min(id) AS id FROM (VALUES {values(NOTICES)}) AS v(id, t) GROUP BY 1),
doc AS (SELECT doc_id, text, {form("text")} AS d FROM documents),
line AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents) WHERE regexp_matches(l, {_quote(NOTICE_CUE)})),
hit AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM line JOIN notice ON notice.d = {form("l")} GROUP BY doc_id)
SELECT doc.doc_id, doc.d AS licence_digest, known.licence_id, coalesce(hit.ids, '') AS notice_ids
FROM doc LEFT JOIN known USING (d) LEFT JOIN hit ON hit.doc_id = doc.doc_id
"""


OP3_SQL = _sql()
