"""Licence scan by canonical digests, in DataFrame operations only.

A text is brought to a canonical form (case, punctuation, white space, copyright lines, equivalent spellings) and its
digest is looked up among the digests of known licence texts by a hash join. The whole text is looked up, and so is each
of its lines, since notices stand on lines of their own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .common import col, small_table, unused

#: Spellings that count as one, as whole words, in this order.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("merchantibility", "merchantability"), ("whilst", "while"), ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"),
    ("organisation", "organization"), ("organisations", "organizations"), ("per cent", "percent"), ("http", "https"),
)

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Fixed values: (licence, known text). Full texts of short licences, and the one-line notices by which works name one.
KNOWN = (
    ("MIT", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_GRANT),
    ("MIT", _MIT_GRANT),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_END),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n1. {_BSD_1}\n\n2. {_BSD_2}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n\n1. {_BSD_1}\n\n2. {_BSD_2}\n\n3. {_BSD_3}\n\n{_BSD_END}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


#: Fixed values: (licence, digest) of widespread files of longer licences, and of wordings that differ in their headings.
DIGESTS = (
    ("Apache-2.0", "b27c759862531cc87d642844b66233c5"),
    ("Apache-2.0", "140fc7dd3fe13f9e3a727dc78d989884"),
    ("Apache-2.0", "e6c7b7269497451001d75f3de65b402f"),
    ("Apache-2.0", "09aa5ff2cdfd26b058df3b4bc7f0032f"),
    ("Apache-2.0", "a9a9b90e689d37bffb3d4e0607c983db"),
    ("GPL-2.0", "cc21314f30c113343b85185fcce3d212"),
    ("GPL-2.0", "e59908d360486cb0fc4b01e63b225f52"),
    ("GPL-2.0", "ea5c4983b5178ad11e35bb94754d2391"),
    ("GPL-3.0", "fa2f63ce647b42d2b2dd7e4090cdbf6a"),
    ("LGPL-2.0", "0bc1e4ffc47d784aa733c56ce9d5fa65"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("GCC-exception-3.1", "0e7dfea9e87d456b839e8f38b26fe68d"),
    ("MPL-2.0", "a27e119cd87d765a971af4667b2bf9b1"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("Python-2.0", "ab665a43933c57bcb1a6cfabf6f0bdc5"),
    ("Python-2.0", "69091b234201887aa94876c22f06d3e8"),
    ("Python-2.0", "80c9a2c11669f292e0a301ce8e4f5fe4"),
    ("Zlib", "443386101934dae03c5b38385fe287a3"),
    ("X11", "c88c1a771464233f48ba09b3ee7d34e5"),
    ("MIT-open-group", "e58d834581b6c44f9e089475b259b2cc"),
    ("blessing", "08c739beb998023603689a0e5073ec8b"),
    ("0BSD", "fa9583358e39e30cc008a801c940fa8c"),
    ("ISC", "c22af3909cee7fd7bba39db6020b278e"),
    ("ISC", "cefced1e03bd18b9560c8a1bb7c1186d"),
    ("MIT", "5fefeb84c2e262528a30c16c8f8d7a34"),
    ("MIT", "0654809a643792890ef9ad53036c8531"),
    ("BSD-2-Clause", "b0538ec125cafeeb58bf11083985630b"),
    ("BSD-2-Clause", "6222f053df59426503c9f9be59942726"),
    ("BSD-3-Clause", "c245a9d439da9a8ea626ab19c280d998"),
    ("BSD-3-Clause", "d4cef4d9ad8054ea8d2cc83477a6f637"),
    ("BSD-3-Clause", "dfd9463b7bcad50bb1270be3d6bf0c2a"),
    ("BSD-3-Clause", "e82046f0b7f72505ecac75064a0d3ab0"),
    ("BSD-3-Clause", "39011f2cfba3de29f89b78678ca27307"),
)


def canonical(text: Column) -> Column:
    """Lower case (A-Z); lines that begin with `copyright`, `(c)` or the sign, or are `all rights reserved`, dropped;
    every run of what is not a letter a-z, digit or non-ASCII character one space; equivalent spellings, as whole words,
    replaced: for that, two spaces stand between words, so that each word has its own."""
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.regexp_replace(out, r"(?dm)^[ \t]*(?:copyright|\(c\)|\x{A9}|all rights reserved)[^\n]*$", " ")
    out = F.trim(F.regexp_replace(out, r"[\x00-/:-`{-\x7F]+", " "))
    out = F.concat(F.lit(" "), F.replace(out, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def known_texts(spark, known=KNOWN) -> DataFrame:
    """(license, canon, digest): the known texts, canonicalised by the same expressions; those without words are left out."""
    rows = small_table(spark, [{"license": a, "t": b} for a, b in known], "license string, t string")
    return rows.select("license", canonical(F.col("t")).alias("canon"), digest(F.col("t")).alias("digest")).where("canon <> ''")


def needed_words(canons: list[str]) -> list[str]:
    """Words (and spellings that count as them) of which every known text has one, so that no other line can match it. Of
    words that stand as they are in any text with that canonical form, those of the most texts come first, then the longest."""
    two = {b for a, b in SPELLINGS if " " in a}
    left = [{w for w in c.split(" ") if w.isascii() and w not in two} for c in canons]
    out: list[str] = []
    while left:
        words = sorted(set().union(*left))
        if not all(left):
            return []
        best = max(words, key=lambda w: (sum(w in x for x in left), len(w)))
        out += [best, *[a for a, b in SPELLINGS if b == best]]
        left = [x for x in left if best not in x]
    return out


def scan(docs: DataFrame, text: str = "text", known=KNOWN, digests=DIGESTS) -> DataFrame:
    """Adds digest string, license string (that of the whole text, else null) and notices array<string> (licences
    whose known text is a whole line, sorted, without repeats). Input columns of these names are replaced.

    `known` are (licence, text), `digests` (licence, digest of a canonical text); both are configuration, thousands of
    rows at most. Where texts agree, the licence first by name counts. Lines are looked up among the texts' digests only.
    Null texts have null results; texts without words have the digest of nothing, which no known text has. Rows are
    looked up one by one, equal texts agree, and no text is shuffled: the digests are broadcast for a hash join, and a
    line's digest is looked up by hashing, too, if the line has a word without which it can't be any of the texts.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("digest", "license", "notices")]
    d, l, m = unused(docs, "_d", "_l", "_m")
    texts = known_texts(spark, known)
    rows = texts.collect()  # of the configuration
    nothing = hashlib.md5(b"").hexdigest()
    given = small_table(spark, [{"license": a, "digest": b} for a, b in digests if b != nothing], "license string, digest string")
    table = texts.select("license", "digest").unionByName(given).groupBy(F.col("digest").alias(d)).agg(F.min("license").alias(l))
    by_digest: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: r.license, reverse=True):
        by_digest[r.digest] = r.license
    none = F.array().cast("array<string>")
    notices = none
    if by_digest:
        lookup = F.create_map(*[F.lit(x) for kv in sorted(by_digest.items()) for x in kv])
        listed = F.array(*[F.lit(x) for x in sorted(by_digest)])
        words = needed_words([r.canon for r in rows])
        has = (lambda x: x.rlike("(?i)" + "|".join(words))) if words else (lambda x: F.lit(True))
        lines = F.filter(F.split(col(text), "\n"), has)
        hits = F.array_intersect(F.transform(lines, digest), listed)
        notices = F.when(has(col(text)), F.array_sort(F.array_distinct(F.transform(hits, lambda x: F.element_at(lookup, x))))).otherwise(none)
    out = docs.select(*[col(c) for c in kept], digest(col(text)).alias(m), F.when(col(text).isNotNull(), notices).alias("notices"))
    out = out.join(F.broadcast(table), F.col(m) == F.col(d), "left")
    return out.select(*[col(c) for c in kept], F.col(m).alias("digest"), F.col(l).alias("license"), "notices")


def op8(docs: DataFrame) -> DataFrame:
    out = scan(docs.select("doc_id", "text"))
    return out.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))
