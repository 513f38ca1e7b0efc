"""Licence scan: canonical digests of whole texts, joined to those of known licences.

A document, each of its paragraphs and each of its lines are looked up as whole texts. All
are brought to one form (case, punctuation, copyright lines, equivalent spellings, white
space), hashed, and the hash is joined with the digests of the known texts, which go
through the same form. Built-in functions only.
"""

from __future__ import annotations

import hashlib
import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and the usual one-line notices.
_PERMISSIVE_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("ISC", _PERMISSIVE_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", _PERMISSIVE_GRANT + ".\n\n" + _ISC_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
#: Identifiers of licences that a file may carry in one line; -only and -or-later go with the version's name.
IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 "
    "CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only "
    "GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 "
    "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 "
    "Ruby Unlicense Unicode-3.0 UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
KNOWN += [(re.sub(r"-only$|-or-later$|\+$", "", x), f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS]
#: Usual expressions of several licences, found under the expression's own name.
EXPRESSIONS = (
    "MIT OR Apache-2.0", "Apache-2.0 OR MIT", "Apache-2.0 WITH LLVM-exception", "GPL-2.0 WITH Linux-syscall-note", "GPL-2.0-only WITH Linux-syscall-note", "GPL-2.0-or-later WITH Linux-syscall-note",
    "GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0 OR MIT", "GPL-2.0-only OR MIT", "GPL-2.0-only OR BSD-3-Clause", "GPL-2.0-only OR BSD-2-Clause", "GPL-2.0-or-later OR MIT", "MIT OR GPL-2.0",
    "MIT AND Apache-2.0", "BSD-3-Clause OR GPL-2.0", "Apache-2.0 OR BSD-2-Clause", "Apache-2.0 OR BSD-3-Clause", "MIT OR Unlicense", "Unlicense OR MIT", "EPL-2.0 OR Apache-2.0", "CDDL-1.0 OR GPL-2.0-only WITH Classpath-exception-2.0",
)
KNOWN += [(x, f"SPDX-License-Identifier: {x}") for x in EXPRESSIONS]
#: Whole licence texts, one a file, named by identifier (what follows an underscore tells variants apart).
KNOWN += sorted((f.name.removesuffix(".txt").split("_")[0], f.read_text(encoding="utf-8")) for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt"))
#: Equivalent spellings, after punctuation has gone; each side is whole words.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"), ("favour", "favor"), ("organisation", "organization"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("and or", "or"), ("v 2", "version 2"), ("v 3", "version 3"), ("v2", "version 2"), ("v3", "version 3"),
]

def canonical(text: Column) -> Column:
    """One form for texts that differ in case, punctuation, copyright lines or spelling only."""
    out = F.regexp_replace(F.lower(text), r"(^|\n)[ \t]*(copyright|\(c\)|all rights reserved)[^\n]*", "$1")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^a-z0-9]+", " "), F.lit(" "))
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    rows = spark.createDataFrame(texts or KNOWN, "license string, known string")
    return rows.select("license", digest(F.col("known")).alias("digest")).distinct()


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """``doc_id, n_matches, whole, licenses`` for every row of ``docs(doc_id, text)``.

    ``n_matches``: texts in it (itself, paragraphs of several lines, lines) that equal a known
    one; ``whole``: the document does; ``licenses``: the licences' names, in order, comma-joined,
    empty if none. Null and empty texts have none. Rows are never merged, ids may repeat or be
    null. Other columns are not read. ``licences(license, digest)`` is the list of known texts,
    a table as small as that list is; a document pays for no other.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paragraphs = F.filter(F.split("text", r"\n[ \t]*\n"), lambda p: F.contains(p, F.lit("\n")) & (p != F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x != F.col("text"))
    unit = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("body"))
    units = F.concat(F.array(unit("document")(F.col("text"))), F.transform(paragraphs, unit("paragraph")), F.transform(lines, unit("line")))
    one = rows.select("row", "doc_id", F.explode(units).alias("u")).select("row", "doc_id", "u.kind", digest(F.col("u.body")).alias("digest"))
    hits = one.join(F.broadcast(licences), "digest", "left")
    found = hits.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.count("license").alias("n_matches"),
        F.max(F.col("license").isNotNull() & (F.col("kind") == "document")).alias("whole"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
    )
    return found.select("doc_id", "n_matches", F.coalesce("whole", F.lit(False)).alias("whole"), "licenses")


def canonical_text(text: str) -> str:
    """What ``canonical`` makes of one text, for the SQL of the scan and for tests."""
    out = re.sub(r"(^|\n)[ \t]*(copyright|\(c\)|all rights reserved)[^\n]*", r"\1", text.lower())
    out = f" {re.sub('[^a-z0-9]+', ' ', out)} "
    for other, usual in SPELLINGS:
        out = out.replace(f" {other} ", f" {usual} ")
    return re.sub(" +", " ", out).strip(" ")


def scan_oracle(known_texts: list[tuple[str, str]] | None = None) -> str:
    """The same scan in DuckDB's SQL, against digests of the known texts."""

    def canon(x: str) -> str:
        out = rf"regexp_replace(lower({x}), '(^|\n)[ \t]*(copyright|\(c\)|all rights reserved)[^\n]*', '\1', 'g')"
        out = f"' ' || regexp_replace({out}, '[^a-z0-9]+', ' ', 'g') || ' '"
        for other, usual in SPELLINGS:
            out = f"replace({out}, ' {other} ', ' {usual} ')"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"

    digests = sorted({(a, hashlib.sha256(canonical_text(b).encode()).hexdigest()) for a, b in known_texts or KNOWN})
    values = ", ".join(f"('{a}', '{b}')" for a, b in digests)
    return f"""
WITH known AS (SELECT * FROM (VALUES {values}) AS k(license, digest)),
rows AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT id, 'document' AS kind, text AS body FROM rows
  UNION ALL SELECT id, 'paragraph', p FROM (SELECT id, text, unnest(string_split_regex(text, '\n[ \t]*\n')) AS p FROM rows) WHERE contains(p, chr(10)) AND p <> text
  UNION ALL SELECT id, 'line', p FROM (SELECT id, text, unnest(string_split(text, chr(10))) AS p FROM rows) WHERE p <> text),
hits AS (SELECT id, kind, license FROM (SELECT id, kind, sha256({canon('body')}) AS digest FROM units) JOIN known USING (digest))
SELECT doc_id, count(license) AS n_matches, coalesce(bool_or(kind = 'document'), false) AS whole, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
FROM rows LEFT JOIN hits USING (id) GROUP BY id, doc_id"""
