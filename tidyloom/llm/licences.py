"""Licence scan by canonical digests.

A text is made canonical (case folded, copyright lines dropped, punctuation and
white space reduced to single blanks, equivalent spellings made one) and hashed.
The digests of entire texts are joined with the digests of known licences; the
lines of a document are looked up in the same way, which finds one-line notices.
The known table is a parameter of a few rows, so Spark broadcasts it by its size.

Of short licences the texts are kept, of longer ones the digests. A digest that a
given table has twice counts for the first of its names.

Only DataFrame functions are used. NULL texts count as empty and match nothing,
rows with equal keys are looked up each by its own text, an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.llm.common import col

# Texts of well-known short licences and usual notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(
    ", provided that the above copyright notice and this permission notice appear in all copies", ""
)
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace(
    "provided with the distribution.",
    """provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
)
LICENCES = [
    ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("ISC", ISC),
    ("MIT", MIT),
    ("Unlicense", UNLICENSE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("all-rights-reserved", "All rights reserved."),
]
# Canonical digests of the entire texts of longer licences.
LONG_LICENCES = [
    ("Apache-2.0", "2e4cf807a79011815071f287c09c05ece57adeb9a42c2805ad7e2137d24f995b"),
    ("Apache-2.0", "fb4f4bd6555f68982aa5e186fc7923cf0e3225a151c20f7695fbd65b3c5c1396"),  # without what follows the terms
    ("Artistic-1.0-Perl", "2d660626e0c71ec2936f0c39b004baf073f7a8d645b56b6191daca4bb56a0e3a"),
    ("CC0-1.0", "bd0e52fb1af40ab9797ba72f1d627b83d449e9926f66d21c51209413ac988137"),
    ("GFDL-1.2-only", "763fd67087ee54c1928a00c7e66bd59138dfa48fb7cf636fe42a828b1c489bcd"),
    ("GFDL-1.3-only", "d76fb8c45f11b761aa1870334672b79fa828bbbd142bbd27f820e7f118b97ad6"),
    ("GPL-1.0-only", "3b7c00b08d5c6de2349faf7a31bb6e49ff8a2273a7cfdd16f96859720b00d9ef"),
    ("GPL-1.0-only", "f4d5622e8488e9135bbad4562a4dddb47eb06044ce19b0c0d2064503f5933de5"),  # without what follows the terms
    ("GPL-2.0-only", "9aae015a6322bbdec1a61c624a33b2c7d3b56283db1642e6e18d7820d4957b61"),
    ("GPL-2.0-only", "3c9f4977ae65ec51dce2737640196c8c2d45aa4ba394ba71168fae3b8a4cc93f"),  # without what follows the terms
    ("GPL-3.0-only", "ab75edbf73a72121bdba9fb3af792f1b33a1533edb22a286043c7478d958ee63"),
    ("GPL-3.0-only", "5d527914d4539f34149cd198edb1e5de52322047d37781b3bd66403f12dc40e1"),  # without what follows the terms
    ("LGPL-2.0-only", "2f0a8618627c179dd830ddb8fa74635ae037468a5880f3b46a73915ae1990c24"),
    ("LGPL-2.0-only", "d449b5d838ee652333de62d88304ddcf67663cda782f1c7257ee9c9dae33dfb4"),  # without what follows the terms
    ("LGPL-2.1-only", "56d21d93f6012cbd7f1195b72528da245ccf843598ff833a87101eb36863f95b"),
    ("LGPL-2.1-only", "a7bd7bcc6f59de5c915482fc3cacdd5a1b6b27c24354df724c2ef3672dce9475"),  # without what follows the terms
    ("LGPL-3.0-only", "f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938"),
    ("MPL-1.1", "8cbbea784c9804a75443faef524d80ac16912119458f901b18d4acb567a2b128"),
    ("MPL-2.0", "a90ba5346ad1927fede05edb2d96afdd4948d68d16cef5d29e84239426134356"),
]
# Spellings that count as equal.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
]
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright[ \t]+(?:\(c\)|©|[0-9<\[{])|\(c\)[ \t]|©)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Canonical form with a blank at either end."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, NOT_WORD, " "), F.lit(" "))
    out = F.replace(out, F.lit("  "), F.lit(" "))
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licences(
    spark: SparkSession, licences: list[tuple[str, str]] = LICENCES, digests: list[tuple[str, str]] = LONG_LICENCES
) -> DataFrame:
    """``licence, digest`` of the known texts and digests."""

    def rows(pairs: list[tuple[str, str]]) -> DataFrame:
        listed = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(t).alias("text")) for n, t in pairs])
        return spark.range(1).select(F.inline(listed.cast("array<struct<licence: string, text: string>>")))

    texts = rows(licences).select("licence", digest(F.col("text")).alias("digest"))
    return texts.unionByName(rows(digests).withColumnRenamed("text", "digest")).distinct()


def scan_licences(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None
) -> DataFrame:
    """``id_col, digest, licence, notices``: by the entire text, and by single lines.

    ``notices`` lists the distinct licences of matching lines by name.
    """
    spark = df.sparkSession
    known = known if known is not None else known_licences(spark)
    known = known.groupBy("digest").agg(F.min("licence").alias("licence"))
    rows = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    # Rows of one key are told apart by a hash of their text.
    mark = F.xxhash64("text").alias("mark")
    lines = rows.select("id", mark, F.explode(F.split("text", "\n")).alias("line"))
    hits = lines.select("id", "mark", digest(F.col("line")).alias("digest")).join(known, "digest")
    notices = hits.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(
        F.array_sort(F.collect_set("licence")).alias("notices")
    )
    whole = rows.select("id", mark, digest(F.col("text")).alias("digest")).join(known, "digest", "left")
    own = F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark"))
    return whole.join(notices, own, "left").select(
        F.col("id").alias(id_col), "digest", "licence",
        F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
    )


def oracle() -> str:
    """The query over ``documents`` as DuckDB SQL."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        out = f"regexp_replace(lower(coalesce({x}, '')), {quoted(COPYRIGHT_LINE)}, '', 'g')"
        out = f"replace(' ' || regexp_replace({out}, {quoted(NOT_WORD)}, ' ', 'g') || ' ', '  ', ' ')"
        for other, usual in SPELLINGS:
            out = f"replace({out}, ' {other} ', ' {usual} ')"
        return f"sha256({out})"

    table = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in LICENCES)
    long = ", ".join(f"({quoted(n)}, {quoted(d)})" for n, d in LONG_LICENCES)
    return f"""
WITH known AS (SELECT DISTINCT licence, {canon("text")} AS digest FROM (VALUES {table}) AS v(licence, text)
    UNION SELECT licence, digest FROM (VALUES {long}) AS v(licence, digest)),
  lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
  hits AS (SELECT DISTINCT doc_id, licence FROM lines JOIN known ON {canon("line")} = digest),
  notices AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS notices FROM hits GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.licence, coalesce(n.notices, '') AS notices
FROM (SELECT doc_id, {canon("text")} AS digest FROM documents) d
LEFT JOIN known k USING (digest) LEFT JOIN notices n USING (doc_id)"""
