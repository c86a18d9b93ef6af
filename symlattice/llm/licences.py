"""Licence scan by canonical digests of entire texts.

A text is put into a canonical form (case, copyright lines, equivalent spellings,
punctuation, space) with built-in functions and hashed; the digest is joined to
the digests of known licences.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs of spellings that licence matching treats as equal.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("modelling", "modeling"), ("noninfringement", "non infringement"),
    ("organisation", "organization"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

_DISCLAIM = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

#: Public licence texts and the usual one-line notices, by identifier.
KNOWN = {
    "MIT": ("MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _DISCLAIM, "Released under the MIT License.", "Licensed under the MIT License."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC,),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC,),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Licensed under the Apache License, Version 2.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
}

#: Lines that may stand above the text of a short licence; of the long ones the title is part of the text.
TITLES = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"),
    "ISC": ("", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("", "Zero-Clause BSD", "BSD Zero Clause License", "BSD-0-Clause", "0BSD"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD-2-Clause", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("", "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD-3-Clause", "BSD License", "The BSD License"),
    "Zlib": ("", "zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "Zlib"),
    "Unlicense": ("", "The Unlicense", "Unlicense"),
    "BSL-1.0": ("",),
}


def _texts() -> dict[str, tuple[str, ...]]:
    """KNOWN, but the complete Unlicense for its beginning, and the complete texts in licence_texts under each title."""
    out = {i: ts for i, ts in KNOWN.items() if i != "Unlicense"}
    for f in sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        i, body = f.name.rsplit(".", 2)[0], f.read_text(encoding="utf-8")
        out[i] = (*out.get(i, ()), *(f"{t}\n\n{body}" if t else body for t in TITLES.get(i, ("",))))
    return out


TEXTS = _texts()


def canonical(text: Column) -> Column:
    """The form that is hashed: ASCII words and numbers in lower case, one space between."""
    t = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t = F.regexp_replace(t, r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*", "\n")
    t = F.trim(F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    put = t
    for a, b in SPELLINGS:
        put = F.regexp_replace(put, rf"\b{a}\b", b)
    # One pass tells the texts that have any of the words; only those are rewritten, word by word.
    return F.when(F.rlike(t, F.lit(r"\b(?:" + "|".join(sorted(a for a, _ in SPELLINGS)) + r")\b")), put).otherwise(t)


def known(spark: SparkSession, texts: dict[str, tuple[str, ...]] = TEXTS) -> DataFrame:
    """digest, license_id; one row for each known text.  At most as large as the given list."""
    rows = [(i, t) for i, ts in sorted(texts.items()) for t in ts]
    df = spark.createDataFrame(rows, "license_id string, text string")
    return df.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts: dict[str, tuple[str, ...]] = TEXTS) -> DataFrame:
    """doc_id, canonical_sha256, n_canonical long, license_id (null: none known).

    The whole text is looked up; a licence line inside other prose is no match.
    Null, empty and all-punctuation texts have the digest of the empty string and
    no licence.  Repeated rows each give a row.
    """
    t = docs.select("doc_id", canonical(F.col("text")).alias("_t")).select("doc_id", F.sha2("_t", 256).alias("canonical_sha256"), F.length("_t").cast("bigint").alias("n_canonical"))
    k = F.broadcast(known(docs.sparkSession, texts))
    return t.join(k, (F.col("canonical_sha256") == F.col("digest")) & (F.col("n_canonical") > 0), "left").select("doc_id", "canonical_sha256", "n_canonical", "license_id")


def oracle(texts: dict[str, tuple[str, ...]] = TEXTS) -> str:
    """DuckDB SQL with the rows of scan(documents)."""

    def form(t: str) -> str:
        t = f"translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        t = rf"regexp_replace({t}, '(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*', chr(10), 'g')"
        t = rf"trim(regexp_replace({t}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
        for a, b in SPELLINGS:
            t = rf"regexp_replace({t}, '\b{a}\b', '{b}', 'g')"
        return t

    rows = ", ".join("('%s', '%s')" % (i, t.replace("'", "''")) for i, ts in sorted(texts.items()) for t in ts)
    return f"""WITH k AS (SELECT sha256({form('text')}) AS digest, min(license_id) AS license_id FROM (VALUES {rows}) v(license_id, text) GROUP BY 1),
      d AS (SELECT doc_id, {form('text')} AS t FROM documents)
      SELECT doc_id, sha256(t) AS canonical_sha256, CAST(length(t) AS BIGINT) AS n_canonical, license_id
      FROM d LEFT JOIN k ON sha256(t) = digest AND length(t) > 0"""
