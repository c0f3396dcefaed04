"""Licence scans: canonical digests of whole texts, hash-joined with known licences. Native: built-in functions only.

The canonical form drops copyright lines, lowers A-Z, turns everything but a-z and 0-9 into single blanks, and replaces
equivalent spellings. Two texts are the same licence if their forms have one SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestat.llm.common import fresh

# Whole lines that name a holder rather than a term.
COPYRIGHT_LINE = r"(?m)^[ \t>*#/;%-]*(?:[Cc]opyright|COPYRIGHT|\([Cc]\)|©|[Aa]ll [Rr]ights [Rr]eserved)[^\n]*$"
# Spellings that licence texts use alike, with the canonical one, in lower case and with single blanks for punctuation.
EQUIVALENT = (
    ("http ", "https "),
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("wilful", "willful"),
    ("fulfil ", "fulfill "),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("copyright owner", "copyright holder"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_TERMS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_TERMS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

# Known licence texts, and one-line notices that name a licence, by identifier.
TEXTS = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TERMS}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TERMS}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_TERMS}"),
    ("BSD-2-Clause", f"{_BSD_GRANT}\n\n{_BSD_TERMS}"),
    ("BSD-3-Clause", f"{_BSD_GRANT}\n\n{_BSD_NAME}\n\n{_BSD_TERMS}"),
    ("Zlib", _ZLIB),
)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"),
)

# SHA-256 of the canonical forms of whole licence texts too long to stand here, by identifier, from the texts that
# Debian's base-files package installs in /usr/share/common-licenses.
DIGESTS = (
    ("Apache-2.0", "3f3112fe3656909b8bf79c7ec7988f83a43b47aeadf2b7d62205aaf449d9f1be"),
    ("Artistic-1.0-Perl", "66e644aafc5ff1de25be918be7e71d1d851bab015f750bc67c5b245e5f33ff39"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "835e93c269f96ffb287b3c8c1c5d41482a48fe84971237b192ae3d0f85299142"),
    ("GFDL-1.3", "2d23a1792689607291f114da9fdb3b413c6ef2346dfb9e4fafe0c5cf9b969da3"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f"),
    ("LGPL-2.0", "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.1", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "8f0473f9c917c507827dca355168119bb065ca1a9dab0e366988bcdba5fa039b"),
)


def plain_lines(text: Column) -> Column:
    """A text line by line in lower case, without copyright lines, with single blanks for what is no letter or digit; null stays null."""
    out = F.translate(F.regexp_replace(text, COPYRIGHT_LINE, ""), _UPPER, _LOWER)
    return F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), "[^a-z0-9\n]+", " ")


def _whole(lines: Column) -> Column:
    """The canonical form of plain lines: joined, trimmed, spelt alike (also where a line break parted a spelling)."""
    return _spelt(F.trim(F.regexp_replace(lines, "[ \n]+", " ")))


def _spelt(form: Column) -> Column:
    for a, b in EQUIVALENT:
        form = F.replace(form, F.lit(a), F.lit(b))
    return form


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    return _whole(plain_lines(text))


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def registry(spark: SparkSession, known: tuple[tuple[str, str], ...], digests: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """license, digest: each digest once (the first identifier by name), of texts or given. A table of constants, a few KB."""
    rows = [F.struct(F.lit(k).alias("license"), digest(canonical(F.lit(v))).alias("digest")) for k, v in known]
    rows += [F.struct(F.lit(k).alias("license"), F.lit(v).alias("digest")) for k, v in digests]
    return spark.range(1).select(F.inline(F.array(*rows))).groupBy("digest").agg(F.min("license").alias("license"))


def scan(
    docs: DataFrame,
    texts: tuple[tuple[str, str], ...] = TEXTS,
    notices: tuple[tuple[str, str], ...] = NOTICES,
    digests: tuple[tuple[str, str], ...] = DIGESTS,
    text: str = "text",
) -> DataFrame:
    """docs with digest, license (of the whole text, null if unknown) and notices (sorted distinct licences whose one-line
    notice is a line of the text); these replace columns of the same name.

    Cases: null text has null digest and license and no notices; an empty text, or one of punctuation alone, has the digest of nothing and
    no license; an empty table gives an empty table; repeated rows each get their row; extra columns pass through.
    """
    spark = docs.sparkSession
    docs = docs.drop("digest", "license", "notices")
    names = [F.col(f"`{c}`") for c in docs.columns]
    form = fresh(docs, "__form")[0]
    formed = docs.select(*names, plain_lines(F.col(f"`{text}`")).alias(form))
    known = F.broadcast(registry(spark, texts, digests))  # constants
    # Lines are looked up by digest too, in the row: a map of a few constants.
    at = {}
    for k, v in sorted(notices):
        at.setdefault(v, k)
    table = F.map_from_entries(F.array_distinct(F.array(*[F.struct(digest(canonical(F.lit(v))), F.lit(k)) for v, k in at.items()])))
    found = F.transform(F.split(form, "\n"), lambda x: F.element_at(table, digest(_spelt(F.trim(x)))))
    kept = F.coalesce(F.array_sort(F.array_distinct(F.array_compact(found))), F.array().cast("array<string>"))
    done = formed.select(*names, digest(_whole(F.col(form))).alias("digest"), kept.alias("notices"))
    return done.join(known, "digest", "left").select(*names, "digest", "license", "notices")
