"""License scans by canonical digest lookup, with DataFrame functions only.

A text's canonical form: A-Z lower-cased, everything but letters a-z, digits and line breaks a space, spelling variants made one, copyright
lines dropped, blanks folded.  Its SHA-256 is looked up among the digests of known licences by a hash join, once for the entire text and
once for each of its lines (short notices are entire texts of their own), so other words in a text or line mean no match.

A null text, and one without letters or digits, matches nothing.  Repeated rows are each scanned; other columns are ignored; an empty table
gives an empty one.  Known licences with one canonical form all count, joined by commas in the order of their names.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: texts of known licences and notices
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]
KNOWN = [("MIT", MIT), ("ISC", ISC), *NOTICES]
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http{}://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http{}://mozilla.org/MPL/2.0/."


def _gnu_header(name: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""


HEADERS = [
    *(("Apache-2.0", APACHE_HEADER.format(s)) for s in ("", "s")),
    *(("MPL-2.0", MPL_HEADER.format(s)) for s in ("", "s")),
    *((f"{short}-{version}-or-later", _gnu_header(name, version.removesuffix(".0"))) for short, name, version in [("GPL", "General Public License", "2.0"), ("GPL", "General Public License", "3.0"), ("LGPL", "Lesser General Public License", "2.1"), ("LGPL", "Lesser General Public License", "3.0")]),
]
#: whole texts, one file each, named by license_id
TEXTS = Path(__file__).parent / "licence_texts"
#: what ends the terms of licences that go on with advice how to apply them
TERMS_END = "END OF TERMS AND CONDITIONS"


def known_licenses() -> list[tuple[str, str]]:
    """(license_id, text) of whole licences with and without their title or closing advice, of headers, notices and SPDX tags."""
    ids = lambda p: p.name.removesuffix(".txt").removesuffix(".regents")
    whole = [*KNOWN[:2], *((ids(p), p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt")))]
    terms = [(i, t[: t.index(TERMS_END) + n]) for i, t in whole if TERMS_END in t for n in (0, len(TERMS_END))]
    untitled = [(i, t.split("\n", 1)[1]) for i, t in whole if t.split("\n", 1)[0] in ("MIT License", "ISC License", "BSD 2-Clause License", "BSD 3-Clause License")]
    tags = [(i, f"SPDX-License-Identifier: {i}") for i in sorted({i for i, _ in [*whole, *HEADERS]})]
    return [*whole, *terms, *untitled, *HEADERS, *tags, *NOTICES]

#: spelling variants, each pattern with what it becomes; they hold for Java's and RE2's expressions alike
SPELLINGS = [
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("non (commercial|infring)", "non$1"),
    ("copyright (owner|holder)", "copyright holder"),
    ("([a-z][a-z][a-z])is(e|ed|es|er|ing|ation|ations)([ \n]|$)", "$1iz$2$3"),
    ("([a-z][a-z])our(s|ed|ing|able|ite|)([ \n]|$)", "$1or$2$3"),
    ("([a-z])ll(ed|ing)([ \n]|$)", "$1l$2$3"),
    ("([a-z])ogue([ \n]|$)", "$1og$2"),
    ("dgement", "dgment"),
    ("merchantibility", "merchantability"),
]
#: a line that only says whose the copyright is
COPYRIGHT = "^(copyright|c)( c)? ([0-9]|year|yyyy|by ).*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, without empty ones and copyright lines."""
    folded = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z0-9\n]+", " ")
    spelled = reduce(lambda c, rule: F.regexp_replace(c, *rule), SPELLINGS, folded)
    return F.filter(F.transform(F.split(spelled, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """digest and license_id of known licences (license_id, text)."""
    known = known if isinstance(known, DataFrame) else spark.createDataFrame(known_licenses() if known is None else known, "license_id string, text string")
    lines = known.select("license_id", F.array_join(canonical_lines(F.col("text")), " ").alias("whole")).filter("whole <> ''")
    return lines.groupBy(F.sha2("whole", 256).alias("digest")).agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("license_id"))


SENT = 100_000  # digests that are sent to all tasks; more are joined by a shuffle


def scan(docs: DataFrame, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, license_id (of the entire text, else null), notices (licences of its lines, distinct, comma-joined, else null), n_notices (lines that match)."""
    # digests are a small table that tasks get whole, if a count says so; a larger one meets the units in a shuffled join
    digests = known_digests(docs.sparkSession, known)
    found = digests.limit(SENT + 1).collect()
    few = len(found) <= SENT
    digests = F.broadcast(docs.sparkSession.createDataFrame(found, digests.schema)) if few else digests
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    sha = lambda c: F.sha2(c, 256)
    whole = F.when(F.size("lines") > 0, F.array(sha(F.array_join("lines", " ")))).otherwise(F.array(F.lit(None).cast("string")))
    units = rows.select("doc_id", F.md5("text").alias("mark"), canonical_lines(F.col("text")).alias("lines"))
    units = units.select("doc_id", "mark", F.posexplode(F.concat(whole, F.transform("lines", sha))).alias("at", "digest"))  # the entire text stands first
    found = units.join(digests, "digest").groupBy("doc_id", "mark").agg(
        F.max(F.when(F.col("at") == 0, F.col("license_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("at") > 0, F.col("license_id")))), ",").alias("notices"),
        F.count_distinct(F.when(F.col("at") > 0, F.col("at"))).alias("n_notices"),
    )
    a, b = rows.select("doc_id", F.md5("text").alias("mark")).alias("a"), found.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.mark") == F.col("b.mark")), "left")
    return joined.select("a.doc_id", "b.license_id", F.nullif("b.notices", F.lit("")).alias("notices"), F.coalesce("b.n_notices", F.lit(0)).cast("long").alias("n_notices"))
