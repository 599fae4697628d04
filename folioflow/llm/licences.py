"""Licences found by the digest of their canonical text, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_digests import TEXT_DIGESTS

# Spellings that count as the same, from licence matching guidelines.
SPELLINGS = (
    ("licences", "licenses"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("programme", "program"),
    ("recognised", "recognized"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("per cent", "percent"),
)

# Public licence texts and the usual notices, by identifier.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,'
    " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
    " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE"
    " FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
    " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
    " DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
    ' software and associated documentation files (the "Software"), to deal in the Software'
    " without restriction, including without limitation the rights to use, copy, modify, merge,"
    " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons"
    " to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or"
    " substantial portions of the Software.\n" + _WARRANTY
)
_ISC_TERMS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO'
    " THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT"
    " SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR"
    " ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF"
    " CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE"
    " OR PERFORMANCE OF THIS SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
    " without fee is hereby granted, provided that the above copyright notice and this permission"
    " notice appear in all copies.\n" + _ISC_TERMS
)
_0BSD = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
    " without fee is hereby granted.\n" + _ISC_TERMS
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will"
    " the authors be held liable for any damages arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial"
    " applications, and to alter it and redistribute it freely, subject to the following"
    " restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote"
    " the original software. If you use this software in a product, an acknowledgment in the"
    " product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as"
    " being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are"
    " permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of"
    " conditions and the following disclaimer in the documentation and/or other materials"
    " provided with the distribution.\n"
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to"
    " endorse or promote products derived from this software without specific prior written"
    " permission.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS'
    " OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF"
    " MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
    " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,"
    " EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF"
    " SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR"
    " TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
    " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
LICENCES: Mapping[str, tuple[str, ...]] = {
    "MIT": (
        _MIT,
        "MIT License\n" + _MIT,
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "ISC": (_ISC, "ISC License\n" + _ISC, "SPDX-License-Identifier: ISC"),
    "0BSD": (_0BSD, "Zero-Clause BSD\n" + _0BSD, "SPDX-License-Identifier: 0BSD"),
    "Zlib": (_ZLIB, "zlib License\n" + _ZLIB, "SPDX-License-Identifier: Zlib"),
    "BSD-2-Clause": (
        _BSD_HEAD + _BSD_TAIL,
        "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL,
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
        "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "This work is licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0-only": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
}

# Fixed patterns over lower-case units of words and single spaces.
COPYRIGHT_LINE = "^(portions )?copyright( |$)|^c [0-9]{4}( |$)|^all rights reserved$"
COPYRIGHT_TERMS = (
    "^(portions )?copyright (and|by law|holders?|in|is|law|laws|license|notice|notices|or|owners?"
    "|statement|the above)( |$)"
)


def respelled(words: Column) -> Column:
    """One spelling of each word, in text with a space on either side of every word."""
    for other, chosen in SPELLINGS:
        words = F.replace(words, F.lit(f" {other} "), F.lit(f" {chosen} "))
    return words


def canonical_units(text: Column) -> Column:
    """The lines of a text in canonical form, without empty and copyright lines.

    Lower case, letters and digits only, single spaces, one spelling of each word. A line that
    opens with a copyright mark goes, unless it goes on as a term of a licence does.
    """
    plain = F.lower(F.replace(text, F.lit("©"), F.lit(" copyright ")))
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}\n]+", " ")
    plain = F.regexp_replace(plain, r" ?\n ?", " \n ")
    plain = respelled(F.concat(F.lit(" "), plain, F.lit(" ")))
    units = F.transform(F.split(plain, "\n"), lambda u: F.trim(F.replace(u, F.lit("  "), F.lit(" "))))
    return F.filter(
        units,
        lambda u: (u != "") & ~(u.rlike(COPYRIGHT_LINE) & ~u.rlike(COPYRIGHT_TERMS)),
    )


def canonical_whole(units: Column) -> Column:
    """The units as one line, where spellings of two words also match across line breaks."""
    return F.trim(respelled(F.concat(F.lit(" "), F.array_join(units, " "), F.lit(" "))))


def digest(words: Column) -> Column:
    return F.sha2(words.cast("binary"), 256)


def known_digests(
    spark: SparkSession, licences: Mapping[str, tuple[str, ...]] = LICENCES
) -> DataFrame:
    """``digest, license_id`` of the canonical form of every known text, one row per digest."""
    rows = [
        F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text"))
        for name, texts in licences.items()
        for text in texts
    ]
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("_row")).select("_row.*")
    whole = canonical_whole(canonical_units(F.col("text")))
    found = table.select(digest(whole).alias("digest"), "license_id")
    if licences is LICENCES:
        pairs = [(d, name) for name, digests in TEXT_DIGESTS.items() for d in digests]
        listed = [F.struct(F.lit(d).alias("digest"), F.lit(n).alias("license_id")) for d, n in pairs]
        more = spark.range(1).select(F.explode(F.array(*listed)).alias("_row")).select("_row.*")
        found = found.union(more)
    return found.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licences(
    docs: DataFrame,
    known: DataFrame | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id, digest, license_id, notices, n_notices`` per row.

    The canonical form of the entire text is looked up by digest (``license_id``, null when it
    is no known text), and so is each of its lines (``notices``: sorted identifiers without
    repeats; ``n_notices``: lines found). ``digest`` is null when nothing is left of a text:
    null, empty, blank, or copyright lines alone. Repeated rows are all returned; a null id is
    kept. Other columns are not read; an empty table gives no rows.

    The list made from ``LICENCES`` has a fixed size and is broadcast; a table given as
    ``known`` (``digest, license_id``, one row per digest) is joined as the planner sees fit.
    Lines meet the digests in the task that reads the text, and what is found is combined
    there before rows are put together by id and all their lines, so that rows of one id whose
    texts differ in line breaks only stay apart.
    """
    listed = F.broadcast(known_digests(docs.sparkSession)) if known is None else known
    listed = listed.select(F.col("digest").alias("_digest"), F.col("license_id").alias("_license"))
    rows = docs.select(
        F.col(id_column).alias("id"), canonical_units(F.col(text_column)).alias("_units")
    )
    rows = rows.withColumn("_lines", F.coalesce("_units", F.array().cast("array<string>")))
    whole = F.when(F.size("_lines") > 0, digest(canonical_whole(F.col("_lines"))))
    form = F.md5(F.array_join("_lines", "\n").cast("binary"))
    rows = rows.select("id", whole.alias("digest"), form.alias("_form"), "_lines")
    marked = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.col("digest").alias("of"))),
        F.transform("_lines", lambda u: F.struct(F.lit(False).alias("whole"), digest(u).alias("of"))),
    )
    units = rows.select("id", "digest", "_form", F.explode(marked).alias("_unit")).select(
        "id", "digest", "_form", "_unit.*"
    )
    joined = units.join(listed, units["of"] == listed["_digest"], "left")
    whole, found = F.col("whole"), F.col("_license").isNotNull()
    return (
        joined.groupBy("id", "digest", "_form")
        .agg(
            F.count_if(whole).alias("_rows"),
            F.max(F.when(whole, F.col("_license"))).alias("license_id"),
            F.sort_array(F.collect_set(F.when(~whole, F.col("_license")))).alias("notices"),
            F.count_if(~whole & found).alias("_found"),
        )
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))))
        .select(
            "id",
            "digest",
            "license_id",
            "notices",
            F.expr("_found DIV _rows").alias("n_notices"),
        )
    )
