import os

import pytest
from pyspark.sql import functions as F

from motionfield.llm.licenses import DIGESTS, HEADERS, TEXTS, known, license_scan


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, license string, n int")
    return {(repr(r.doc_id), r.license, r.n_notice_lines, r.notices, r.text_digest is None) for r in license_scan(df).collect()}


def test_variants_of_a_text_and_edges(spark):
    mit = TEXTS["MIT"]
    docs = [
        (1, mit), (2, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ;").replace("LICENSE", "LICENCE")), (3, mit + " more"), (4, "Text\nReleased under the MIT Licence!\nAll rights reserved.\n  all  rights reserved"),
        (5, None), (6, ""), (7, "?!\n--"), (8, TEXTS["ISC"]), (8, TEXTS["ISC"]), (None, TEXTS["0BSD"]), (9, "word " * 50000),
    ]
    assert run(spark, docs) == {
        ("1", "MIT", 0, "", False), ("2", "MIT", 0, "", False), ("3", None, 0, "", False), ("4", None, 3, "MIT,proprietary", False), ("5", None, 0, "", True), ("6", None, 0, "", True),
        ("7", None, 0, "", True), ("8", "ISC", 0, "", False), ("None", "0BSD", 0, "", False), ("9", None, 0, "", False),
    }
    assert run(spark, []) == set()


def test_lines_of_repeated_rows_count_once(spark):
    docs = [(1, "All rights reserved.")] * 3
    assert run(spark, docs) == {("1", "proprietary", 1, "proprietary", False)}


def test_headers_notices_and_spellings_over_line_ends(spark):
    docs = [
        (1, HEADERS["GPL-3.0"].replace("\n\n", "\n \n# ")), (2, "This software is released under the terms of the Mozilla Public Licence, version 2.0"), (3, "Licensed under CC BY-NC-SA 4.0.\n\nSPDX-License-Identifier: BSD-3-Clause"),
        (4, "a per\ncent b"), (5, "a percent b"), (6, "Licensed under the BSD License"), (7, "x\r\nAll rights reserved.\r\n"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(df).collect()}
    assert [got[k].license for k in (1, 2, 3, 6)] == ["GPL-3.0", "MPL-2.0", None, "BSD"]
    assert got[3].notices == "BSD-3-Clause,CC-BY-NC-SA-4.0" and got[7].notices == "proprietary"
    assert got[4].text_digest == got[5].text_digest


def test_a_registry_of_the_users(spark):
    mine = known(spark.createDataFrame([("house", "Our own\nlicence."), ("house", None), ("b", "?")], "license string, text string"))
    df = spark.createDataFrame([(1, "our OWN license"), (2, "text\nOur own license!"), (3, TEXTS["MIT"]), (4, "...")], "doc_id long, text string")
    assert {(r.doc_id, r.license, r.notices) for r in license_scan(df, registry=mine).collect()} == {(1, "house", "house"), (2, None, "house"), (3, None, ""), (4, None, "")}


def test_digests_are_those_of_the_texts(spark):
    folder = "/usr/share/common-licenses"
    rows = [(k, open(p, encoding="utf-8").read()) for k in DIGESTS if os.path.exists(p := f"{folder}/{k.removesuffix('.0') if k[0] in 'GL' and 'GFDL' not in k else k}")]
    if not rows:
        pytest.skip("no such folder here")
    for r in known(spark.createDataFrame(rows, "license string, text string")).collect():
        assert DIGESTS[r.license] == r.digest
    assert {r.license for r in license_scan(spark.createDataFrame(rows, "doc_id string, text string")).select("doc_id", F.col("license")).collect()} == {k for k, _ in rows}


def test_two_licences_of_one_wording(spark):
    """Known texts that are equal once canonical: the smaller name is given."""
    texts = spark.createDataFrame([("B-2", "Permission is granted, to ALL."), ("A-1", "permission is granted to all")], "license string, text string")
    docs = spark.createDataFrame([(1, "Permission is granted to all!"), (2, "none")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in license_scan(docs, registry=known(texts)).collect()} == {1: "A-1", 2: None}
