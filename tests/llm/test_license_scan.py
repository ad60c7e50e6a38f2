"""Licence sentences and rules; the SQL form on given and odd tables."""

import os

import duckdb
import pytest
from conftest import SF_ORACLE
from fixtures_llm import write_tables
from oracle_compare import compare

from gridload.llm import license_scan as L
from gridload.llm.oracle import ORACLE_SQL
from gridload.llm.queries import QUERIES

MIT = """Copyright (c) 2021 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL3 = ("This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.")
CASES = [
    (1, MIT, "MIT", ""),
    (2, "Some prose.\nReleased under the MIT License. More prose.", "MIT", ""),
    (3, "| a | b\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.",
     "Apache-2.0,CC-BY-NC-4.0", ""),
    (4, GPL3, "GPL-3.0-or-later", ""),
    (5, "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", ""),
    (6, "All rights reserved. Nothing else", "", "All-rights"),
    (7, "we mention the mit license in passing", "", ""),
    (8, None, "", ""),
    (9, "", "", ""),
    (10, "See the GNU General Public License for more details. Released under the MIT License.",
     "MIT", "GPL-details"),
]


@pytest.mark.parametrize("row", CASES, ids=lambda r: str(r[0]))
def test_cases(spark, row):
    doc_id, text, licences, unmatched = row
    (got,) = L.scan(spark.createDataFrame([(doc_id, text)], "doc_id int, text string")).collect()
    assert (got.licences, got.unmatched, got.has_licence) == (licences, unmatched, licences != "")


def test_longer_rules_come_first_and_consume():
    ids = [i for _, names in L.RULES for i in names]
    assert set(ids) | {"All-rights"} <= {name for name, _ in L.SENTENCES}
    for k, (_, names) in enumerate(L.RULES):
        for _, later in L.RULES[:k]:
            assert f"|{'|'.join(later)}|" not in f"|{'|'.join(names)}|", (later, names)


def test_every_known_sentence_has_a_hint():
    for _, sentence in L.SENTENCES:
        assert any(h in sentence.lower() for h in L.HINTS), sentence


def test_matches_sql_on_the_given_tables(spark):
    r = compare(spark, QUERIES["op1_license_scan"], ORACLE_SQL["op1_license_scan"], SF_ORACLE)
    assert r["columns_match"] and r["exact_match"], r


def test_plan_has_no_python_and_no_shuffle(spark):
    from plan_text import plan

    text = plan(QUERIES["op1_license_scan"](spark, SF_ORACLE), "simple")
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


MPL = ("This Source Code Form is subject to the terms of the Mozilla Public\n"
       "License, v. 2.0. If a copy of the MPL was not distributed with this\n"
       "file, You can obtain one at http://mozilla.org/MPL/2.0/.")
GPL2 = ("This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.")


INNER = [
    (MPL, "MPL-2-ref", "MPL-2.0"),
    ("/* " + MPL.replace("\n", "\n * ") + " */", "MPL-2-ref", "MPL-2.0"),
    (MPL.replace("\n", " "), "MPL-2-ref", "MPL-2.0"),
    (MPL.replace("v. 2.0", "v.2.0"), "MPL-2-ref", "MPL-2.0"),
    (MPL.replace("v. 2.0", "v.\n2.0"), "MPL-2-ref", "MPL-2.0"),
    ("This software is at version\n2.0\nand so on", "", ""),
    ("The software. 2.0. Next", "", ""),
    ("Licensed under the Apache License, v. 2.0.", "", ""),
    ("Mozilla Public License, v. 2.0.", "", ""),
    ("Licensed under the Apache License, Version\n2.0.", "Apache-2-ref", "Apache-2.0"),
    ("Licensed under the Apache License, Version 2.0\n(the \"License\");", "Apache-2-ref",
     "Apache-2.0"),
    (GPL2, "GPL-free,GPL-2-later", "GPL-2.0-or-later"),
    (GPL2.replace(" ", "\n"), "GPL-free,GPL-2-later", "GPL-2.0-or-later"),
    ("Software: either version 2 of the License, or (at your option) any later version.", "", ""),
]


@pytest.mark.parametrize("text,ids,licences", INNER)
def test_sentences_with_inner_ends_and_wrapped_ones(spark, text, ids, licences):
    (got,) = L.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert (got.sentence_ids, got.licences) == (ids, licences)


def test_a_tie_goes_to_the_longer_match(spark):
    # lines know "MIT License", the paragraph the longer wrapped sentence
    text = "MIT License\nA note. This project is licensed\nunder the MIT License."
    (got,) = L.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert got.sentence_ids == "MIT-ref"


APACHE = "Licensed under the Apache License, Version 2.0."
SPLIT = GPL2.replace("software; you", f"software. {APACHE} You")


def test_a_taken_place_stays_between_its_neighbours(spark):
    far = GPL2.replace("software; you", "software.\n" + "Other prose here.\n" * 20 + "You")
    rows = [(1, SPLIT), (2, far)]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id int, text string"))
           .collect()}
    assert (got[1].licences, got[1].unmatched) == ("Apache-2.0", "GPL-free,GPL-2-later")
    assert (got[2].licences, got[2].unmatched) == ("GPL-2.0-or-later", "")


def test_sentences_and_rules_of_the_caller(spark):
    sentences = [("own-a", "Use at will. v. 7 applies"), ("own-b", "Do no harm")]
    rules = [("Own-1", ("own-a", "own-b")), ("Own-2", ("own-b",))]
    rows = [(1, "Use at will. v. 7 applies. Hello there. Do no harm!"), (2, "do no harm"),
            (3, "use at will"), (4, MIT)]
    for hints in ((), ("will", "harm")):
        got = L.scan(spark.createDataFrame(rows, "doc_id int, text string"),
                     sentences=sentences, rules=rules, hints=hints).collect()
        assert {r.doc_id: r.licences for r in got} == {1: "Own-1", 2: "Own-2", 3: "", 4: ""}


def test_empty(spark, empty_dir):
    assert QUERIES["op1_license_scan"](spark, empty_dir).collect() == []


def test_matches_sql_on_odd_rows(spark, workdir):
    texts = [t for _, t, _, _ in CASES] + [t for t, _, _ in INNER] + [
        SPLIT, MIT + MPL + GPL2, "MIT License\nA note. This project is licensed\nunder the MIT License.",
        f"{MPL}\n\n2.0\n{APACHE} {APACHE} v. 2.0.", "software ; ; . 2.0 ! " * 40]
    write_tables(spark, workdir, rows=[(k, t, "en", "a") for k, t in enumerate(texts)] +
                 [(None, MIT.replace("\n", "\r\n"), None, None)])
    got = QUERIES["op1_license_scan"](spark, workdir)
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet("
                f"'{os.path.join(workdir, 'documents.parquet')}/*.parquet')")
    cur = con.execute(ORACLE_SQL["op1_license_scan"])
    names = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == want
