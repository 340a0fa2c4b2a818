"""Licence scan by digests of canonical texts, in DataFrame functions only.

A text's canonical form is lower case, without lines that state a copyright and marks of list points, with every run of
other characters than letters and digits as one space, without a title before the text, and with equivalent
spellings (also of a BSD licence's holder) made equal. Its digest is joined by hash to the digests of known licences and notices. Both whole
texts and their lines are looked up, so a licence that is the whole text and a notice that is a
line of its own are found; part of a line is not. Known are the texts of KNOWN and, by their digests, longer ones (LONG); of AGPL and
of Creative Commons but CC0 only notices of one line are. More can be given as rows of known.

Defined cases: null and empty texts hold no licence; a line that is stated twice counts twice;
equal rows are one in the count; a null doc_id is a document; other columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table

#: Spellings taken as equal, in canonical text (fixed values).
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("the regents and contributors", "the copyright holders and contributors"),
    ("the regents or contributors", "the copyright holder or contributors"),
    ("copyright holders or contributors", "copyright holder or contributors"),
)

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n"
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    'permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
    "THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Known licences and notices: public texts, fixed values.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", _MIT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "Released under the GPLv3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.\n" + _BSD_END,
    ),
    ("ISC", _ISC),
    ("Proprietary", "All rights reserved."),
)
#: Digests of canonical forms of longer public licences, whole: fixed values.
LONG = (
    ("0BSD", "fa9583358e39e30cc008a801c940fa8c"),
    ("Apache-2.0", "f235baeb0cc96393cff2f3cf5e1c3f80"),  # with its appendix
    ("Apache-2.0", "a6e8ec0fbfb004fe4c59705b94e91657"),  # without
    ("Apache-2.0", "2f892c0fd3770558483d26775fbb4fd1"),  # without, nor its last line
    ("Apache-2.0", "3f75cdec37a8a9cf2daa486022386970"),  # the notice for files
    ("Artistic-1.0", "dc4a091dae3cbb0eaa99c7976db9c452"),
    ("CC0-1.0", "33b60d2bcc436a336d1830b3b1c03687"),
    ("GFDL-1.2", "2628e8541ed40d1ca39714d87d6f13d8"),
    ("GFDL-1.3", "096872d613522d79a9fb20e3b0340067"),
    ("GPL-1.0", "7a036ff0eaba33d600fcee8a7e8a18b9"),
    ("GPL-2.0", "26b2bfb32c731688a49c7316842df11c"),
    ("GPL-3.0", "052052dd29901dc0d593afc1e192ada0"),
    ("LGPL-2.0", "6864521c23f1c2e80411a1dc03de6943"),
    ("LGPL-2.1", "7efc7aa444f21739b39cb187f690cb47"),
    ("LGPL-3.0", "45ec14853d944805ef573d0b3a40cda3"),
    ("MPL-1.1", "f926d8d68c3da15ad7535d937b09e7df"),
    ("MPL-2.0", "229c8893de543577d6e0e57223457445"),
)
#: Words that follow "copyright" where a licence speaks of it; any other word there names a holder.
TERMS = (
    "act and are as assignment can claim claims disclaimer does for has have header holder holders if in information infringement interest interests is it its law laws "
    "licence license licensed licenses material materials may must notice notices of on or owner owners ownership permission protection right rights shall statement "
    "statements status terms that this to treaty under which will with without"
).split()


def _other(words: list[str], top: bool = True) -> str:
    """Pattern of the rest of a line that does not begin with one of these words. SQL's patterns have no lookahead."""
    letters = "".join(sorted({w[0] for w in words if w}))
    options = [rf"[^{letters}\P{{L}}][^\n]*", r"\p{N}[^\n]*"] + [c + _other([w[1:] for w in words if w and w[0] == c], False) for c in letters]
    if not top and "" not in words:
        options.append(r"(?:[^\p{L}\p{N}\n][^\n]*)?")
    return "(?:" + "|".join(options) + ")"


#: A line that states a copyright: the word or sign with a year, a sign or a holder; not a line of terms that begins with the word, nor point (c) of a list.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:©[^\n]*|\(c\)[^\p{L}\p{N}\n]*(?:copyright|\p{N}{4})[^\n]*"
    r"|copyrights?(?:[^\p{L}\p{N}\n]*(?:\(c\)|©|\p{N})[^\n]*|[^\p{L}\p{N}\n]+" + _other(TERMS) + "))$"
)
#: A mark of a list's point at the beginning of a line.
POINT = r"(?m)^[^\p{L}\p{N}\n]*(?:\p{N}{1,2}|[a-z])[.)][ \t]+"
OTHERS = r"[^\p{L}\p{N}]+"
#: What may stand before a licence: its title, and the end of a copyright line that was wrapped. Only before further text.
TITLE = r"^(?:this software is released under )?(?:the )?(?:mit|isc|bsd|bsd [23] clause|(?:new|modified|revised|simplified) bsd) license (?:mit |isc )?([^ ])"
RIGHTS = r"^(?:all )?rights reserved ([^ ])"
#: The holder's name in the third condition of a BSD licence, and what stands for it.
HOLDER = r"neither the names? of (?:[^ ]+ ){1,12}?nor the names of (?:its |any |the )?contributors"
ANY_HOLDER = "neither the name of the copyright holder nor the names of its contributors"


def canonical(text: Column) -> Column:
    plain = F.lower(text)
    for pattern, by in ((COPYRIGHT_LINE, ""), (POINT, ""), (OTHERS, " ")):
        plain = F.regexp_replace(plain, pattern, by)
    plain = F.trim(plain)
    for pattern in (TITLE, RIGHTS):
        plain = F.regexp_replace(plain, pattern, "$1")
    spelled = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, plain)
    return F.regexp_replace(spelled, HOLDER, ANY_HOLDER)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """license and digest, from rows of license and text (else KNOWN and LONG); of two licences of one digest the first by name."""
    texts = spark.createDataFrame(list(KNOWN), "license string, text string") if known is None else known
    digests = texts.select("license", F.md5(canonical(F.col("text")).cast("binary")).alias("digest"))
    if known is None:
        digests = digests.unionByName(spark.createDataFrame(list(LONG), "license string, digest string"))
    return digests.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, whole_license (of the text as a whole, or null), licenses (names, sorted) and n_notices (lines) of each document.

    known: rows of license and text instead of KNOWN. It is broadcast up to broadcast_rows rows.
    """
    digests = known_digests(docs.sparkSession, known)
    if known is None or digests.count() <= broadcast_rows:
        digests = F.broadcast(digests)
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.md5(text.cast("binary")).alias("raw"), F.posexplode(F.concat(F.array(text), F.split(text, "\n"))).alias("at", "unit"))
    # A line's canonical form needs no second look for a text of one line.
    looked = lines.select("doc_id", "raw", "at", F.md5(canonical(F.col("unit")).cast("binary")).alias("digest")).join(digests, "digest", "left")
    found = looked.filter("at = 0 OR license IS NOT NULL").groupBy("doc_id", "raw").agg(
        F.max(F.when(F.col("at") == 0, F.col("license"))).alias("whole_license"),
        F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("licenses"),
        F.size(F.collect_set(F.when((F.col("at") > 0) & F.col("license").isNotNull(), F.col("at")))).cast("long").alias("n_notices"),
        F.sum(F.when(F.col("at") == 0, 1)).alias("rows"),
    )
    return found.select("doc_id", "whole_license", "licenses", "n_notices", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row")).drop("_row")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(x: str) -> str:
    x = f"lower({x})"
    for pattern, by in ((COPYRIGHT_LINE, ""), (POINT, ""), (OTHERS, " ")):
        x = f"regexp_replace({x}, {_sql_text(pattern)}, '{by}', 'g')"
    x = f"trim({x})"
    for pattern in (TITLE, RIGHTS):
        x = f"regexp_replace({x}, {_sql_text(pattern)}, '\\1')"
    x = reduce(lambda y, pair: f"replace({y}, '{pair[0]}', '{pair[1]}')", SPELLINGS, x)
    return f"regexp_replace({x}, {_sql_text(HOLDER)}, '{ANY_HOLDER}', 'g')"


ORACLE = f"""
WITH known AS (SELECT digest, min(l) AS license FROM (
  SELECT l, md5({_sql_canonical('t')}) AS digest FROM (VALUES {", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in KNOWN)}) AS k(l, t)
  UNION ALL VALUES {", ".join(f"('{n}', '{d}')" for n, d in LONG)}) GROUP BY 1),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
noticed AS (SELECT doc_id, license, count(*) AS n FROM lines JOIN known ON md5({_sql_canonical('line')}) = digest GROUP BY ALL),
whole AS (SELECT doc_id, max(license) AS whole_license FROM docs LEFT JOIN known ON md5({_sql_canonical('text')}) = digest GROUP BY doc_id),
named AS (SELECT doc_id, license FROM noticed UNION SELECT doc_id, whole_license FROM whole WHERE whole_license IS NOT NULL)
SELECT doc_id, whole_license,
  coalesce((SELECT string_agg(license, ',' ORDER BY license) FROM named n WHERE n.doc_id = w.doc_id), '') AS licenses,
  coalesce((SELECT CAST(sum(n) AS BIGINT) FROM noticed n WHERE n.doc_id = w.doc_id), 0) AS n_notices
FROM whole w
"""

QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES = {"op9_license_scan": ORACLE}
