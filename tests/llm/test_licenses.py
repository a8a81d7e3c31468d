"""Whole texts of licences and their headers are known."""

from __future__ import annotations

import textwrap
from pathlib import Path

import duckdb
import pytest

from loomtext.llm import licenses
from loomtext.llm.sql import OP5

COMMON = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0"}


def test_sql_knows_whole_texts(spark, tmp_path):
    """DuckDB's SQL finds the same licences in entire texts, changed in case, blanks, spelling and holder, and in lines."""
    known = licenses.known_licenses()
    rows = [(i, f"Copyright (c) {1990 + i % 30} Holder {i}\n{t.upper() if i % 2 else t.replace(' ', '  ')}") for i, (_, t) in enumerate(known)]
    rows += [(1000 + i, f"prose before\n{t}\nprose after") for i, (_, t) in enumerate(known)] + [(5000, None), (5001, ""), (5002, "no licence")]
    folder = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(folder)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/*.parquet'")
    found = licenses.scan(spark.read.parquet(folder))
    want = con.execute(f"select {', '.join(found.columns)} from ({OP5})").fetchall()
    got = [tuple(r) for r in found.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {i for i, name, *_ in got if name} >= set(range(len(known)))


@pytest.mark.skipif(not COMMON.exists(), reason="the system has no licence texts")
def test_whole_texts(spark):
    texts = {i: (COMMON / f).read_text("utf-8") for f, i in FILES.items()}
    texts["Unlicense"] = (licenses.TEXTS / "Unlicense.txt").read_text()
    for i in ("BSD-2-Clause", "BSD-3-Clause"):
        texts[f"{i} untitled"] = (licenses.TEXTS / f"{i}.txt").read_text().split("\n", 1)[1].replace("<year>, <owner>", "2024, Someone")
    texts["Apache-2.0 terms"] = texts["Apache-2.0"].split("   APPENDIX:")[0]
    texts["Apache-2.0 header"] = "Copyright 2024 Someone\n" + textwrap.fill(licenses.HEADERS[0][1], 72)
    texts["GPL-3.0-or-later header"] = textwrap.fill(licenses._gnu_header("General Public License", "3"), 60)
    texts["MPL-2.0 indented"] = textwrap.indent(texts["MPL-2.0"], "// ")
    names = list(texts)
    docs = spark.createDataFrame([(n, texts[x]) for n, x in enumerate(names)] + [(100, "x " + texts["GPL-3.0-only"]), (101, "words\nSPDX-License-Identifier: MPL-2.0")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {x: got[n]["license_id"] for n, x in enumerate(names)} == {x: x.split(" ")[0] for x in names}
    assert got[100]["license_id"] is None and got[101]["license_id"] is None and got[101]["notices"] == "MPL-2.0"
