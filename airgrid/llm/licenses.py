"""Licence scan by canonical digest lookup (DataFrame operations only).

A text is brought to a canonical form - lower case, statements of ownership removed,
punctuation and white space reduced to single spaces, equivalent spellings unified;
where its lines are wrapped does not matter - and the SHA-256 of the whole form is joined to the digests of known
licences, which are made by the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Statements of ownership (in lower case), and spellings that licence
# matching treats as the same word.  A statement ends with its sentence, its line or
# where a licence begins, so a licence on the same line stays.
_BEGIN = (r"(?:permission\s+(?:is\s+(?:hereby\s+)?granted|to\s+use)|redistributions?\s+(?:and\s+use|of\s+source)|"
          r"this\s+(?:software|work|program|library|file|project|source\s+code)\s+is|licen[cs]ed\s+under|released\s+under|"
          r"distributed\s+under|everyone\s+is\s+permitted|51\s+franklin|59\s+temple|all\s+rights\s+reserved|"
          r"(?:the\s+)?(?:mit|isc|bsd|zlib|apache|mozilla|boost)\s[^\n]{0,30}?licen[cs]e\b)")
_SHORT = r"\b(?:inc|ltd|co|corp|llc|gmbh|jr|sr|al|\p{L})"
_NAME = (rf"(?:[^\n.]|\.(?=\S)|(?<={_SHORT})\.){{0,600}}?(?:(?<!{_SHORT})\.(?=\s|\z)|(?=\n|\z)|(?=[\s,;]{_BEGIN}))"
         r"(?:[^\p{L}\p{N}\n]*all rights reserved\b)?")
_SIGN = r"(?:\(c\)|©)"
_NO_NAME = r"(?!\s+(?:notice|holder|owner|law|licen[cs]|statement|act|and|or|in|is|are|was|interest|protect|infring|claim|treat)\p{L}*\b)"
_TITLE = (r"(?:[\p{L}\p{N}.\-]+[^\p{L}\p{N}]+){0,6}?licen[cs]e\b(?:\s*\([^)\n]{1,30}\))?"
          r"(?:,?\s+version\s+[\d.]+(?:,\s+(?:\d+\s+)?\p{L}+\s+\d+)?)?")
OWNERSHIP = [
    # At the head of the text, after a title if there is one: a year, a sign or a name follows.
    (rf"\G((?:[^\p{{L}}\p{{N}}]*{_TITLE})?[^\p{{L}}\p{{N}}]*)(?:(?:portions\s+)?(?:copyright\b{_NO_NAME}|{_SIGN})"
     rf"[^\p{{L}}\p{{N}}]*(?:c\)[^\p{{L}}\p{{N}}]*)?[\p{{L}}\p{{N}}]{_NAME}|all\s+rights\s+reserved\b)", "$1 "),
    # On a later line: only with a year, or with the word, a sign and a name.
    (rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?:portions )?(?:(?:copyright[ \t]*{_SIGN}?|{_SIGN})[ \t]*\d{{4}}|"
     rf"copyright[ \t]*{_SIGN}[ \t]*\p{{L}}){_NAME}", " "),
    (r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$", " "),
]
SPELLINGS = [
    (r"\b(sub)?licenc(e|es|ed|ing|ee|ees|or|ors)\b", "$1licens$2"),
    (r"\b(author|organ|recogn|util|real|initial|final|maxim|minim|custom)is(e|es|ed|ing|ation|ations)\b", "$1iz$2"),
    (r"\b(behavi|fav|col|hon|lab)our", "$1or"),
    (r"\b(judg|acknowledg)ement", "$1ment"),
    (r"\bfulfil(s|ment)?\b", "fulfill$1"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bwhilst\b", "while"),
    (r"\bnon[ -]commercial", "noncommercial"),
    (r"\bper cent\b", "percent"),
    (r"\bsub[ -]licens", "sublicens"),
]

# Licence texts and notices as their publishers state them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
]


def canonical(text: Column) -> Column:
    """Canonical form of a whole text; null counts as empty."""
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\r", "")
    for pattern, left in OWNERSHIP:
        c = F.regexp_replace(c, pattern, left)
    c = F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")      # before the spellings: they do not see line ends
    for pattern, same in SPELLINGS:
        c = F.regexp_replace(c, pattern, same)
    return F.trim(c)


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    rows = spark.createDataFrame(KNOWN if texts is None else texts, "license_id string, text string")
    return digests(rows, "text").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def digests(df: DataFrame, text_col: str = "text", out: str = "digest") -> DataFrame:
    return df.withColumn(out, F.sha2(canonical(F.col(text_col)), 256))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest of the canonical whole text and license_id (null if the text is no known licence).

    ``known``: different digests with a license_id, of any size (Catalyst picks the join).
    Empty, null and punctuation-only texts share the digest of the empty form and match
    nothing, unless a known text is empty too.  Repeated rows are looked up one by one.
    """
    own = digests(docs.select(F.col(id_col), F.col(text_col).alias("_text")), "_text").select(id_col, "digest")
    return own.join(known.select("digest", "license_id"), "digest", "left").select(id_col, "digest", "license_id")
