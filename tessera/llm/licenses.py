"""Licence scan by canonical digests, with DataFrame functions only.

A text is brought to a canonical form: lower case; copyright lines (and "all rights reserved") dropped; every run of
characters other than letters and digits one space; equivalent spellings of whole words replaced. The SHA-256
of that form is joined with the digests of known licences, so that a text matches if all of it is a licence.
The same is done for each line of a text, which is looked up among known one-line notices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small

#: Variant and canonical spelling of whole words, applied in this order to lower-case text (fixed values).
SPELLINGS = [
    ("all rights reserved", ""), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"),
    ("licencee", "licensee"), ("licencees", "licensees"), ("licencor", "licensor"), ("sub licence", "sublicense"), ("sub license", "sublicense"),
    ("sublicence", "sublicense"), ("sub licensed", "sublicensed"), ("sub licensing", "sublicensing"), ("sub program", "subprogram"),
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("judgement", "judgment"), ("analogue", "analog"),
    ("analyse", "analyze"), ("artefact", "artifact"), ("artefacts", "artifacts"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("defence", "defense"), ("favour", "favor"), ("favourite", "favorite"), ("behaviour", "behavior"),
    ("honour", "honor"), ("labour", "labor"), ("labelling", "labeling"), ("modelling", "modeling"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("instalment", "installment"), ("offence", "offense"), ("practise", "practice"), ("programme", "program"), ("programmes", "programs"),
    ("wilful", "willful"), ("whilst", "while"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owner"),
    ("copyright owners", "copyright owner"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("per cent", "percent"),
    ("web site", "website"), ("http", "https"),
]
#: Words that are spelled with s or z before these endings (fixed values).
STEMS, ENDINGS = "authori capitali categori customi emphasi finali generali initiali maximi optimi organi reali recogni speciali summari utili", "e es ed er ers ing ation ations"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
"""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MORE = """

For more information, please refer to <https://unlicense.org/>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution."""
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this
restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""

#: Licence id and text; published licence texts (fixed values).
LICENSES = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT", "The MIT License\n\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("ISC", _ISC.replace("and/or", "and")),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("BSD-2-Clause", _BSD.format(third="")), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD.format(third="")),
    ("BSD-3-Clause", _BSD.format(third=_THIRD)), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD.format(third=_THIRD)),
    ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + _MORE), ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB), ("BSL-1.0", _BSL),
]

#: Licence id and SHA-256 of the canonical form of longer published texts: whole, and without the appendix that says
#: how to apply it (fixed values).
DIGESTS = [
    ("Apache-2.0", "129294488cadbe2acee6d28d177d42a3acc4e0cfb69893738a3ca4965b35cdf9"),
    ("Apache-2.0", "4f14b6cbdd362d5a6d1023eaee7538d57a6c9271c5e1de4bdc60e02a182c0730"),
    ("Artistic-1.0-Perl", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "1c6a0963deeffee930e28d43a0e77e2e978e3c33b7c06f8f6e532d5a944ac0f3"),
    ("GFDL-1.2", "490eb2c193cd0b439b6a74baab275f3611cab01e8addd30f291e3970a3263f52"),
    ("GFDL-1.3", "49e72078516b5ea91a3f43b4854407a8b9b2fa2e185cadc01acbc28ea05f565b"),
    ("GFDL-1.3", "8af0eb1e6e33b76c674a59b299246eb58aa9934c8e4c9a1b1959a4022cd8aa5e"),
    ("GPL-1.0", "596622575bcd3d827e7f6bce1f02e32bed2edeb0e9d8ce0d39441ba10031d1aa"),
    ("GPL-1.0", "895ad9f6ba7614276f464f8c82a8f6ebb7f9605f2ab3c7f933b3193e1c0abdda"),
    ("GPL-2.0", "632eed5ccd9536a119e4736f4111f5ea096d69650e17f4a3fcacb4d273e39aec"),
    ("GPL-2.0", "34646b71cb057a6b7fce252fc5685bc0f1ad2c22262d322eca0a90f39b1a0046"),
    ("GPL-3.0", "eda670dbdc2a527a84996ab06686efba23dcadd696672fe5fc676a347ca3d715"),
    ("GPL-3.0", "ebadbe8cfae7d11d120cf5404b8b09223fa4e270aa6724b0d909d68507a64b1d"),
    ("LGPL-2.0", "87c83ddf13b8d772a493615bbfb7368fb6c87b179e064f6b4573dd9008cbd283"),
    ("LGPL-2.0", "273fdbba53ad074b35cd45b58c1a4091f92c5a5d5027978e989cbbb73746d404"),
    ("LGPL-2.1", "4b7fd8442d92b28972b9aee4eb75166ac0ea6267095bdcdbe488d5f54b725b71"),
    ("LGPL-2.1", "f2113c5811629fb98497e5231be94432e92103fa33213fede9037b754d55e19b"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-1.1", "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
]

#: Licence ids and the names by which notices call them (fixed values).
NAMES = [
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache-2.0 License"), ("MIT", "MIT License"),
    ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-2.0", "GPLv2"), ("GPL-3.0", "GNU General Public License, version 3"), ("GPL-3.0", "GNU General Public License v3.0"),
    ("GPL-3.0", "GPLv3"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), ("Unlicense", "Unlicense"), ("BSL-1.0", "Boost Software License, Version 1.0"),
]
#: What stands before a name, and ids that an SPDX line may end in besides the licence's own.
FORMS = ["Licensed under the ", "Licensed under ", "Released under the ", "Distributed under the ", "This work is licensed under the ", "This work is licensed under a "]
SUFFIXES = ["", "-only", "-or-later"]


def notices() -> list[tuple[str, str]]:
    """Licence id and line of each one-line notice."""
    named = [(k, form + name) for k, name in NAMES for form in FORMS]
    ids = sorted({k for k, _ in NAMES})
    spdx = [(k, f"SPDX-License-Identifier: {k}{x}") for k in ids for x in (SUFFIXES if "GPL" in k else [""])]
    return [*named, *spdx, ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");')]


_COPYRIGHT = r"^[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©|:|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)[^\n]*$"


def _folded(text: F.Column) -> F.Column:
    """Canonical form with line feeds kept; words and line feeds have single spaces between them."""
    t = F.lower(F.coalesce(text, F.lit("")))
    marked = t.contains("copyright") | t.contains("©") | t.contains("(c)")
    t = F.when(marked, F.regexp_replace(t, "(?md)" + _COPYRIGHT, "")).otherwise(t)
    # two spaces between words, so that each word has its own on either side
    t = F.concat(F.lit(" "), F.replace(F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    t = F.regexp_replace(t, _ENDED, " $1z$2 ")
    for variant, canonical in SPELLINGS:
        t = F.replace(t, F.lit(_spaced(variant)), F.lit(_spaced(canonical)))
    return F.regexp_replace(t, " +", " ")


_ENDED = f" ({STEMS.replace(' ', '|')})s({ENDINGS.replace(' ', '|')}) "


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def _one_line(folded: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(folded, "[ \n]+", " "))


def known(spark: SparkSession, rows: list[tuple[str, str]], digests: list[tuple[str, str]] = ()) -> DataFrame:
    """license_id and digest of each distinct canonical form of rows (id, text), and of digests (id, digest); ties:
    the least id."""
    df = spark.createDataFrame(rows, "license_id string, text string").select("license_id", F.sha2(_one_line(_folded(F.col("text"))), 256).alias("digest"))
    df = df.union(spark.createDataFrame(list(digests), "license_id string, digest string"))
    return df.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame, notices: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """docs with digest, license_id (all of the text is that licence; else null) and notice_ids.

    licenses: license_id, digest (see known()). notices: license id and line; bounded, held in the plan.
    notice_ids: the sorted distinct ids of notices that fill a line of the text, comma-joined, or empty.
    Null texts count as empty; empty texts and texts of marks alone match nothing but have a digest.
    Rows that repeat give repeated rows; other columns stay, but digest, license_id and notice_ids of docs
    are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("digest", "license_id", "notice_ids", "__folded")
    by_line: dict[str, str] = {}
    lines = spark.createDataFrame(list(notices), "license_id string, line string").select("license_id", _one_line(_folded(F.col("line"))).alias("x"))
    for row in lines.collect():
        by_line[row.x] = min(row.license_id, by_line.get(row.x, row.license_id))
    keys = F.array(*[F.lit(k) for k in sorted(by_line)])
    values = F.array(*[F.lit(by_line[k]) for k in sorted(by_line)])
    lines = F.transform(F.split("__folded", "\n"), lambda x: F.trim(x))
    found = F.transform(F.array_intersect(lines, keys), lambda x: F.element_at(values, F.array_position(keys, x).cast("int")))
    docs = docs.withColumn("__folded", _folded(F.col(text))).withColumns({
        "digest": F.sha2(_one_line(F.col("__folded")), 256),
        "notice_ids": F.array_join(F.array_sort(F.array_distinct(found)), ",") if by_line else F.lit(""),
    })
    return docs.drop("__folded").join(small(licenses.select("digest", "license_id")), "digest", "left")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, known(spark, LICENSES, DIGESTS), notices()).select("doc_id", "digest", "license_id", "notice_ids")


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_folded(x: str) -> str:
    x = f"lower(coalesce({x}, ''))"
    x = f"regexp_replace({x}, {_sql_text('(?m)' + _COPYRIGHT)}, '', 'g')"
    x = f"regexp_replace({x}, {_sql_text(r'[^\p{L}\p{N}\n]+')}, '  ', 'g')"
    x = f"regexp_replace(' ' || replace({x}, chr(10), ' ' || chr(10) || ' ') || ' ', '{_ENDED}', ' \\1z\\2 ', 'g')"
    for variant, canonical in SPELLINGS:
        x = f"replace({x}, '{_spaced(variant)}', '{_spaced(canonical)}')"
    return f"regexp_replace({x}, ' +', ' ', 'g')"


def oracle() -> str:
    def rows(pairs):
        return ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in pairs)

    one = "trim(regexp_replace(folded, '[ \\n]+', ' ', 'g'))"
    return f"""
WITH l AS (SELECT license_id, {_sql_folded("text")} AS folded FROM (VALUES {rows(LICENSES)}) v(license_id, text)),
k AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256({one}) AS digest FROM l
      UNION ALL SELECT * FROM (VALUES {rows(DIGESTS)}) v(license_id, digest)) GROUP BY 1),
n AS (SELECT {one} AS line, min(license_id) AS license_id
      FROM (SELECT license_id, {_sql_folded("text")} AS folded FROM (VALUES {rows(notices())}) v(license_id, text)) GROUP BY 1),
d AS (SELECT doc_id, {_sql_folded("text")} AS folded FROM documents),
x AS (SELECT doc_id, trim(unnest(string_split(folded, chr(10)))) AS line FROM d),
f AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids FROM x JOIN n USING (line) GROUP BY doc_id)
SELECT d.doc_id, sha256({one}) AS digest, k.license_id, coalesce(f.notice_ids, '') AS notice_ids
FROM d LEFT JOIN k ON k.digest = sha256({one}) LEFT JOIN f ON f.doc_id = d.doc_id"""
