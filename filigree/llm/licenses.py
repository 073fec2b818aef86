"""Licence texts by the digest of their canonical form.

A text is lower-cased, loses its copyright lines, takes one spelling of words that licence texts spell in more than one
way, and keeps letters and digits alone, with single blanks between words. The digest of all that is left is
joined by hash with the digests of known texts. The known side is a fixed list, so it is broadcast.

Defined results: a null or empty text, or one of copyright lines alone, has no licence; each repeated row and null id
gives a row of its own; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.text import id_and_text

#: A notice names a year, a sign or an owner; a wrapped sentence that begins with the word alone is none.
COPYRIGHT_LINE = r"\n[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|by |:)|\(c\)|©|all rights reserved)[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"

# Equivalent spellings, and public licence texts and notices.
SPELLINGS = [
    ("licenc", "licens"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"),
    ("authoris", "authoriz"), ("redistributer", "redistributor"), ("favour", "favor"), ("honour", "honor"),
    ("fulfilment", "fulfillment"), ("whilst", "while"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("non-commercial", "noncommercial"), ("sub-licens", "sublicens"), ("https://", "http://"),
]
_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution.\n"
)
_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
            "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
            "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
            "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
            "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _TWO + _WARRANTY),
    ("BSD-3-Clause", _TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
                            "endorse or promote products derived from this software without specific prior written "
                            "permission.\n" + _WARRANTY),
    ("ISC", _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n"
            + _NO_WARRANTY),
    ("0BSD", _GRANT + ".\n" + _NO_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


def canonical(text: Column) -> Column:
    """The form that digests are taken of."""
    out = F.regexp_replace(F.concat(F.lit("\n"), F.lower(text)), COPYRIGHT_LINE, "\n")
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(usual))
    return F.trim(F.regexp_replace(out, OTHER, " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """digest and licence of known texts; of equal ones the first name in order stands."""
    rows = spark.createDataFrame(known, "licence string, text string")
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("licence").alias("licence"))


def find_licences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest of the canonical text, and licence (null if no known text has it)."""
    texts = id_and_text(docs, id_col, text_col).select("id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    sides = known.select(F.col("digest").alias("known"), "licence").where(F.col("known") != F.sha2(F.lit(""), 256))
    return texts.join(F.broadcast(sides), F.col("digest") == F.col("known"), "left").select("id", "digest", "licence")


def oracle_sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"regexp_replace(chr(10) || lower({column}), {quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
        for other, usual in SPELLINGS:
            out = f"replace({out}, {quoted(other)}, {quoted(usual)})"
        return f"sha256(trim(regexp_replace({out}, {quoted(OTHER)}, ' ', 'g')))"

    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
    with known as (select {form('text')} as digest, min(licence) as licence from (values {values}) v(licence, text) group by 1),
    d as (select doc_id, {form("coalesce(text, '')")} as digest from documents)
    select d.doc_id, d.digest, known.licence from d left join known on d.digest = known.digest and d.digest <> sha256('')"""
