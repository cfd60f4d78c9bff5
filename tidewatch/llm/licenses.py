"""Licence scan by canonical digest: normalised texts are looked up whole among the digests of known licences.

A text is normalised like this: lines that are copyright notices go; lower case; every run of other characters than letters and digits
becomes one space; "all rights reserved" goes; equivalent spellings become one (licence, sublicence, and the like). So how a licence is
wrapped makes no difference. Its SHA-256 is joined to the digests of known texts. Each text is normalised once, line by line; units are
the whole document, each paragraph and each line, so that a licence text or a notice inside a document is found where it stands
alone. A licence of several paragraphs is also known by its long ones. Known texts are normalised by the same function.

Ties: a digest that several licences share (the disclaimer of MIT and MIT-0, say) counts as "A OR B", names sorted, and only where the
document has none of them by itself.

Defined cases: null and empty texts match nothing; very long texts are digested whole; several matches of one licence in a document are one
row with a count; equal rows, and rows that share an id, give a row each; an empty table gives no rows; a null doc_id is kept; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import durable

# Short licence texts and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MIT_0 = MIT[: MIT.index(", subject to the following")] + "." + MIT[MIT.index("\n\nTHE SOFTWARE") :]
ZERO_BSD = ISC[: ISC.index(", provided that")] + "." + ISC[ISC.index("\n\nTHE SOFTWARE") :]
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

# Full texts: BSD and Unlicense without notice and title, the others as their publishers give them.
BSD_2, BSD_3, UNLICENSE, APACHE = ((Path(__file__).parent / "known" / f"{n}.txt").read_text() for n in ("BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Apache-2.0"))
_TERMS = APACHE[: APACHE.index("END OF TERMS AND CONDITIONS")]
LONG = {n: (Path(__file__).parent / "known" / f"{n}.txt").read_text() for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")}
# each with what may follow its terms left out
_ENDS = {"GPL-2.0": "END OF TERMS AND CONDITIONS", "GPL-3.0": "END OF TERMS AND CONDITIONS", "LGPL-2.1": "END OF TERMS AND CONDITIONS", "MPL-2.0": "Exhibit A - Source Code Form License Notice"}
_LONG = [(n, part) for n, t in LONG.items() for part in [t, *([t[: t.index(_ENDS[n])], t[: t.index(_ENDS[n])] + "END OF TERMS AND CONDITIONS"] if n in _ENDS else [])]]
# the conditions of a BSD licence are numbered or have other marks
_BSD = [(name, head + text) for name, n, full in (("BSD-2-Clause", "2", BSD_2), ("BSD-3-Clause", "3", BSD_3)) for text in (full, re.sub(r"(?m)^ *\d\. ", "", full)) for head in ("", f"BSD {n}-Clause License\n\n", f"The BSD {n}-Clause License\n\n")]

KNOWN: list[tuple[str, str]] = [
    *_BSD,
    *_LONG,
    ("MIT-0", MIT_0),
    ("MIT-0", f"MIT No Attribution\n\n{MIT_0}"),
    ("0BSD", ZERO_BSD),
    ("0BSD", f"BSD Zero Clause License\n\n{ZERO_BSD}"),
    ("0BSD", f"Zero-Clause BSD\n\n{ZERO_BSD}"),
    ("Zlib", ZLIB),
    ("Zlib", f"zlib License\n\n{ZLIB}"),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE[: UNLICENSE.index("For more information")]),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", f"{_TERMS}END OF TERMS AND CONDITIONS"),
    ("Apache-2.0", _TERMS),
    ("MIT", MIT),
    ("MIT", f"MIT License\n\n{MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{MIT}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", ISC),
    ("ISC", f"ISC License\n\n{ISC}"),
    ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]
# a longer licence is also known by each of its long paragraphs, so that it is found inside a document
KNOWN += [(name, part) for name, text in list(KNOWN) if "\n\n" in text for part in re.split(r"\n\s*\n", text) if len(part.split()) >= 25]
# Equivalent spellings, longest first.
SPELLINGS = [
    ("sublicence", "sublicense"), ("licence", "license"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"),
    ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfill", "fulfil"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("modelling", "modeling"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("https", "http"),
]
RESERVED = " all rights reserved "
_YEAR = r"(?:\d{4}|[\[{<(][ \t]*(?i:yyyy|year))"
# A notice has a sign, a year, "by" or a name after the word, or is a short line with a sign of its own; other lines that begin with the
# word, or with (c) as a list's mark, are wrapped text.
COPYRIGHT = (
    r"(?m)^[ \t>*#/;-]*(?:©|(?i:copyright)[ \t:,-]*(?:(?i:\(c\)|©|by\b)|" + _YEAR + r")|(?i:\(c\))[ \t]*(?:(?i:copyright|by)\b|" + _YEAR + r"|(?=[^\n]{0,60}(?:\n[ \t>*#/;-]*\n|\s*\Z)))"
    r"|Copyright[ \t]+(?!(?i:holder|owner|notice|law|licen[cs]e))\p{Lu})[^\n]*$"
)


SCOPES = ("text", "paragraph", "line")
_notice = regex.compile(COPYRIGHT).sub
_may_hold_notice = re.compile(r"copyright|©|\(c\)", re.IGNORECASE).search
_words = re.compile(r"[^\W_]+").findall
_folded: dict[str, str] = {}
FOLDED = 200_000  #: words whose spelling a worker keeps
BITS = 20  #: of a digest, in the table of possible ones


def fold(word: str) -> str:
    for a, b in SPELLINGS:
        word = word.replace(a, b)
    return word


def without_notices(text: str) -> str:
    """The same number of lines; those that are copyright notices are empty."""
    return _notice("", text) if _may_hold_notice(text) else text


def folded(line: str) -> str:
    """The words of a line in lower case and one spelling."""
    out = []
    for w in _words(line.lower()):
        known = _folded.get(w)
        if known is None:
            if len(_folded) >= FOLDED:
                _folded.clear()
            known = _folded[w] = fold(w)
        out.append(known)
    return " ".join(out)


def joined(lines: list[str]) -> str:
    """Folded lines as one normal text. The reserved notice goes only where other words stand beside it; alone it is a notice of its own."""
    text = f" {' '.join(filter(None, lines))} ".replace(" copyright holder", " copyright owner")
    while RESERVED in text and text != RESERVED:
        text = text.replace(RESERVED, " ", 1)
    return text.strip()


def normalise(text: str) -> str:
    return joined([folded(line) for line in without_notices(text).split("\n")])


def units(text: str) -> Iterator[tuple[int, str]]:
    """(scope, normal text) of the whole text and, where there are several, of its paragraphs and lines."""
    plain = text.split("\n")
    lines = [folded(line) for line in without_notices(text).split("\n")]
    yield 0, joined(lines)
    if len(lines) > 1:
        start = 0
        blank = [k for k, line in enumerate(plain) if not line.strip()]
        for k in [*blank, len(lines)] if any(0 < k < len(lines) - 1 for k in blank) else []:
            if k > start:
                yield 1, joined(lines[start:k])
            start = k + 1
        for line in lines:
            yield 2, joined([line])


def digest(normal: str) -> str:
    return hashlib.sha256(normal.encode()).hexdigest()


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """digest, license; ``known`` may be a table (license, text) of any size."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            normal = [normalise(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(n) if n else None for n in normal], pa.string())], names=["license", "digest"])

    table = known if isinstance(known, DataFrame) else spark.createDataFrame(known or KNOWN, "license string, text string")
    rows = table.select(F.col("license").cast("string"), F.col("text").cast("string")).mapInArrow(run, "license string, digest string").where("digest IS NOT NULL")
    return rows.groupBy("digest").agg(F.array_join(F.sort_array(F.collect_set("license")), " OR ").alias("license"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """doc_id, license, scope (text, paragraph or line: the widest that matched), n_matches.

    A table of 2^20 bits says which leading bits a known digest has; units without them cannot match and are not sent. The others are
    joined on the whole digest; Spark broadcasts the known side only if it proves small.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    digests = durable(known_digests(spark, known), "digests")
    bits = bytearray(1 << (BITS - 3))
    for (k,) in digests.select(F.conv(F.substring("digest", 1, BITS // 4), 16, 10).cast("long")).distinct().toLocalIterator():  # 2^20 at most
        bits[k >> 3] |= 1 << (k & 7)
    shared = spark.sparkContext.broadcast(bytes(bits))

    def run(batches: Iterator) -> Iterator:
        possible = shared.value
        for batch in batches:
            out = []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for scope, normal in units(text.as_py() or ""):
                    if normal:
                        d = digest(normal)
                        k = int(d[: BITS // 4], 16)
                        if possible[k >> 3] >> (k & 7) & 1:
                            out.append((doc, row, scope, d))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "row", "o", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    hits = rows.mapInArrow(run, "doc_id long, row long, o int, digest string").join(digests, "digest")
    # an all-blank-but-one-line text matches as text and as line: the widest scope counts
    by = hits.groupBy("doc_id", "row", "license", "o").agg(F.count(F.lit(1)).alias("n"))
    out = by.groupBy("doc_id", "row", "license").agg(F.min("o").alias("o"), F.min_by("n", "o").alias("n_matches"))
    # a part that several licences share says nothing where one of them is found by more
    names, several = F.collect_set("license").over(Window.partitionBy("row")), F.split("license", " OR ")
    out = out.withColumn("plain", (F.size(several) == 1) | ~F.arrays_overlap(several, names)).where("plain")
    return out.select("doc_id", "license", F.element_at(F.array(*map(F.lit, SCOPES)), F.col("o") + 1).alias("scope"), "n_matches")
