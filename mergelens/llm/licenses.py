"""License scans by canonical digests, native throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.llm._store import keyed, materialise

#: Spellings that count as one; the second takes the place of the first.
SPELLINGS = [
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authoris", "authoriz"), ("behaviour", "behavior"), ("cancelled", "canceled"), ("catalogue", "catalog"),
    ("categoris", "categoriz"), ("centre", "center"), ("customis", "customiz"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("initialis", "initializ"), ("judgement", "judgment"), ("labour", "labor"), ("maximis", "maximiz"), ("merchantibility", "merchantability"),
    ("modelled", "modeled"), ("non-commercial", "noncommercial"), ("offence", "offense"), ("organis", "organiz"),
    ("programme", "program"), ("realis", "realiz"), ("recognis", "recogniz"), ("sub-licens", "sublicens"), ("utilis", "utiliz"),
    ("whilst", "while"), ("wilful", "willful"), ("https://", "http://"),
]
#: Two words, on one line or two, of which the second becomes another.
OWNER = (r"\b(copyright[ \t\n]+)owner", "holder")
#: Lines that name a holder and a year, and what else says nothing of the terms.
HOLDER = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|©|\(c\))[^\n]*(?:\(c\)|©|[0-9]{4}|<year>|\[year\]|\[yyyy\])[^\n]*$"
RESERVED = r"all rights reserved\.?"
BULLET = r"(^|[ \t\n])\(?(?:[0-9]{1,2}|[a-z])[.)]([ \t\n]|$)"  # anywhere: where a line begins depends on how it is wrapped
MARKS = r"[^\p{L}\p{N}]+"

#: Whole texts by SPDX id.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
}
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace(
    "\n\nTHIS SOFTWARE",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE",
)
#: SHA-256 of the canonical form of longer texts, as they are published and, where they end in an appendix,
#: up to the end of the terms. A test derives them from the texts where a system has those.
DIGESTS = {
    "Apache-2.0": ["d8422e1617021cb06c01115595a128f9adfa8441d2672a7891ec319e196630ec", "726990ae159b4e29a39a568e3d75f384789eeaabf0d2a85256ef93c8bd55b4e6"],
    "Artistic-1.0-Perl": ["4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651"],
    "CC0-1.0": ["38ef173883793b023a74895ce0af4bbdeb6bb0bc904463871c507b03695c9c81"],
    "GFDL-1.2": ["acec3597763489be8ef21cf2e96b3ed208cb48bcddc6c598aff3724672e280f0"],
    "GFDL-1.3": ["96126db0aa4a0e77dd3344ee5c1afb9c7243997a829d69325ebcb1448f7264e3"],
    "GPL-1.0": ["7b343fe698ba364e09227ae272f6764e5caa8d1e282beb53d8a59278f82ed242", "747297ecf29429fff72f8119146b5f17b0a1c2aec561bac4913720428af3cf75"],
    "GPL-2.0": ["8749bf3bc8d64b7b01f56e6146d2212fce3f355b4dc5c247753f8b96071c7894", "f5f444394912ae2bc65e44425f0a3a8071b2f7f2ad2df371789e0f95c5382893"],
    "GPL-3.0": ["78aa23ce656f8a21031b020b4bae1939f1744d60cfeea294bdd8249729cdfc5c", "50861e8ddaa22b0a4e33b4d32b1e75a2a9d9949b5074bb0c40f927db93cdd7b0"],
    "LGPL-2.0": ["e3320b0735f02e7844613fcdbac0b85180577f6be7c2fa0a125580d7768eaef5", "f6dc5cd2f8d56b80dacf0b5f4412099e7029d054beea86e0ce0dcd3098e9f5c1"],
    "LGPL-2.1": ["8af9e66a26153d73af584ba1d0597c8667a788aba9fd08837c3f7a6571c9fdf3", "6ad660ce7213b3936d685c9ada84361135e273f79189cf0cd0a298e16764def8"],
    "LGPL-3.0": ["6a1e21cb1f0adda77c68071a8eeadb804a92ffdcaa150c17f976711652333fa0"],
    "MPL-1.1": ["5aa16067e47a822b554b495ff7af4677e24d8672c24a205ea3050b9cc509139b"],
    "MPL-2.0": ["5b3f6d23fe8b43a89beb9abe4a2615ea12be4b87a8a8217c10abf91990dd0994"],
}
#: Names that titles and notices use, by SPDX id.
NAMES = {
    "MIT": ["MIT License"], "ISC": ["ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"], "Zlib": ["zlib License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"], "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPLv2"], "GPL-3.0": ["GNU General Public License, version 3", "GPLv3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"], "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"], "CC0-1.0": ["CC0 1.0"],
}
NOTICES = ["Released under the {}.", "Released under {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the {}.", "This project is licensed under the {}."]


def known_texts() -> list[tuple[str, str, str]]:
    """(SPDX id, kind, text): whole texts with and without their titles, digests of others, and one-line notices."""
    whole = [(i, "text", head + text) for i, text in TEXTS.items() for head in ["", *[n + "\n\n" for n in NAMES[i]], *["The " + n + "\n\n" for n in NAMES[i]]]]
    lines = [(i, "notice", n.format(name)) for i, names in NAMES.items() for name in names for n in NOTICES]
    return whole + [(i, "digest", x) for i, digests in DIGESTS.items() for x in digests] + lines + [(i, "notice", f"SPDX-License-Identifier: {i}") for i in NAMES]


def _terms(text: Column) -> Column:
    """Lower-cased text without lines that name holders, in one spelling."""
    text = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    text = F.regexp_replace(F.regexp_replace(text, HOLDER, ""), RESERVED, "")
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(text, OWNER[0], "$1" + OWNER[1])
    return F.regexp_replace(text, BULLET, "$1$2")


def _line(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, MARKS, " "))


def canonical(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with canon_lines: the lines of ``text`` in canonical form, empty ones left out."""
    return df.withColumn("canon_lines", F.filter(F.transform(F.split(_terms(F.coalesce(text, F.lit(""))), "\n"), _line), lambda x: x != ""))


def scan_licenses(docs: DataFrame, known: DataFrame, max_known: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_sha256, license_id, notice_ids, n_notice_lines of every row of ``docs``.

    ``known``: license_id, kind (``text``, ``digest`` or ``notice``), text; a digest is the SHA-256 of a text's canonical
    form, in lowercase hex. license_id is the licence whose text the whole document is
    in canonical form, null if none (the least id if several share a text); notice_ids lists, sorted and joined by commas,
    the licences of notices that are a line of the document, n_notice_lines counts those lines. The known digests are
    broadcast while they are ``max_known`` rows or fewer and joined by a shuffle beyond. A null text is empty and has the
    digest of nothing; rows that repeat id and text are judged alike; an empty table gives an empty one. Other columns of
    ``docs`` are read by nothing.
    """
    published = known.where("kind = 'digest'").select(F.col("text").alias("canonical_sha256"), "license_id")
    mine = canonical(known.where("kind <> 'digest'"), F.col("text")).select("license_id", "kind", F.array_join("canon_lines", " ").alias("canon")).where("canon <> ''")
    mine = mine.groupBy("kind", "canon").agg(F.min("license_id").alias("license_id"))
    few = known.count() <= max_known
    sized = F.broadcast if few else (lambda df: df)
    whole = mine.where("kind = 'text'").select(F.sha2("canon", 256).alias("canonical_sha256"), "license_id").union(published)
    whole = whole.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    notices = mine.where("kind = 'notice'").select(F.xxhash64("canon").alias("line"), "canon", F.col("license_id").alias("notice"))

    rows = canonical(keyed(docs, id_col, text_col), F.col("text"))
    digests = F.transform("canon_lines", lambda x: F.xxhash64(x))
    rows = rows.select("doc_id", "dk", "th", F.sha2(F.array_join("canon_lines", " "), 256).alias("canonical_sha256"), digests.alias("lines"))
    rows = materialise(rows, "licenses-digests")
    lines = rows.select("dk", "th", F.posexplode("lines").alias("pos", "line")).join(sized(notices.select("line", "notice")), "line")
    found = lines.groupBy("dk", "th").agg(F.array_join(F.sort_array(F.collect_set("notice")), ",").alias("notice_ids"), F.count_distinct("pos").alias("n_notice_lines"))
    out = rows.select("doc_id", "dk", "th", "canonical_sha256").join(sized(whole), "canonical_sha256", "left").join(found, ["dk", "th"], "left")
    return out.select("doc_id", "canonical_sha256", "license_id", F.coalesce("notice_ids", F.lit("")).alias("notice_ids"), F.coalesce("n_notice_lines", F.lit(0)).cast("long").alias("n_notice_lines"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(known_texts(), "license_id string, kind string, text string")
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), known)


def oracle() -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    terms = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz' || chr(10))"
    terms = f"regexp_replace(regexp_replace({terms}, {q(HOLDER)}, '', 'g'), {q(RESERVED)}, '', 'g')"
    for a, b in SPELLINGS:
        terms = f"replace({terms}, {q(a)}, {q(b)})"
    terms = f"regexp_replace({terms}, {q(OWNER[0])}, {q(chr(92) + '1' + OWNER[1])}, 'g')"
    terms = f"regexp_replace({terms}, {q(BULLET)}, {q(chr(92) + '1' + chr(92) + '2')}, 'g')"
    lines = f"list_filter(list_transform(string_split({terms}, chr(10)), lambda x: trim(regexp_replace(x, {q(MARKS)}, ' ', 'g'))), lambda x: x <> '')"
    values = ", ".join(f"({q(i)}, {q(k)}, {q(t)})" for i, k, t in known_texts())
    return f"""
WITH k0(license_id, kind, t) AS (VALUES {values}),
k AS (SELECT kind, array_to_string({lines}, ' ') AS canon, min(license_id) AS license_id FROM k0 WHERE kind <> 'digest' GROUP BY ALL),
wh AS (SELECT h, min(license_id) AS license_id FROM (SELECT sha256(canon) AS h, license_id FROM k WHERE kind = 'text' UNION ALL SELECT t, license_id FROM k0 WHERE kind = 'digest') GROUP BY h),
d0 AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT r, doc_id, {lines} AS ls FROM d0),
f AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids, count(*) AS n FROM (SELECT r, unnest(ls) AS canon FROM d) JOIN k USING (canon) WHERE kind = 'notice' GROUP BY r)
SELECT doc_id, sha256(array_to_string(ls, ' ')) AS canonical_sha256, wh.license_id, coalesce(ids, '') AS notice_ids, CAST(coalesce(f.n, 0) AS BIGINT) AS n_notice_lines
FROM d LEFT JOIN wh ON wh.h = sha256(array_to_string(ls, ' ')) LEFT JOIN f ON f.r = d.r
"""


ORACLE = oracle()
