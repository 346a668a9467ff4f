import os

import pytest

from tidyloom.llm.licences import BSD_2, BSD_3, ISC, LICENCES, LONG_LICENCES, MIT, known_licences, scan_licences


def test_entire_texts_and_lines(spark):
    own = "Copyright (c) 2021 Some One <a@b.c>\n\n"
    rows = [
        (1, own + MIT), (2, MIT.replace("\n", " ").upper()), (3, MIT + " and more"), (4, "MIT License? no"),
        (5, ISC.replace(",", " ,").replace("fee", "fee ")), (6, "intro\nLicenced under the APACHE licence - version 2.0\nmore"),
        (7, "(c) 2020 X\n" + BSD_2), (8, "all rights reserved\nReleased under the MIT License"), (9, ""), (10, None),
        (11, "All Rights Reserved!"), (12, "x" * 200_000 + "\nLicensed under CC BY-NC 4.0."),
        (8, "all rights reserved\nReleased under the MIT License"), (None, "All rights reserved."),
    ]
    df = spark.createDataFrame([(k, t, "q") for k, t in rows], "doc_id long, text string, licence string")
    got = {r.doc_id: (r.licence, r.notices) for r in scan_licences(df).collect()}
    assert got == {
        1: ("MIT", []), 2: ("MIT", ["MIT"]), 3: (None, []), 4: (None, []), 5: ("ISC", []), 6: (None, ["Apache-2.0"]),
        7: ("BSD-2-Clause", []), 8: (None, ["MIT", "all-rights-reserved"]), 9: (None, []), 10: (None, []),
        11: ("all-rights-reserved", ["all-rights-reserved"]), 12: (None, ["CC-BY-NC-4.0"]),
        None: ("all-rights-reserved", ["all-rights-reserved"]),
    }
    assert scan_licences(df).count() == len(rows)
    assert scan_licences(df.where("false")).count() == 0


def test_known_licences_have_different_digests(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(LICENCES)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licences(df).collect()}
    assert [got[i].licence for i in range(len(LICENCES))] == [n for n, _ in LICENCES]
    assert len({r.digest for r in got.values()}) == len(LICENCES)


def test_rows_of_one_key_have_their_own_notices(spark):
    rows = [(1, "Released under the MIT License."), (1, "plain text"), (1, None), (None, "All rights reserved."), (None, "none"), (1, "plain text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.licence or "", tuple(r.notices)) for r in scan_licences(df).collect())
    assert got == [(0, "", ()), (0, "all-rights-reserved", ("all-rights-reserved",)), (1, "", ()), (1, "", ()), (1, "", ()), (1, "MIT", ("MIT",))]


def test_known_table_with_two_names_for_a_digest(spark):
    known = known_licences(spark, [("b", "Some text"), ("a", "some TEXT!"), ("c", "other")], [])
    df = spark.createDataFrame([(1, "some text"), (2, "other")], "doc_id long, text string")
    assert sorted((r.doc_id, r.licence, tuple(r.notices)) for r in scan_licences(df, known=known).collect()) == [(1, "a", ("a",)), (2, "c", ("c",))]


FOLDER = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licence texts on this machine")
def test_entire_long_licences(spark):
    """The texts themselves, with other line ends, quotes and copyright lines."""
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only",
             "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3-only"}
    rows = []
    for i, (file, name) in enumerate(sorted(names.items())):
        path = os.path.join(FOLDER, file)
        if os.path.exists(path):
            text = open(path, encoding="utf-8", errors="replace").read()
            rows += [(name, text), (name, "Copyright (c) 2024 Some One\n\n" + text.replace("  ", " ").upper()), (None, text + " and more")]
    rows.append(("BSD-3-Clause", "(c) 2019 X\n" + BSD_3))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in scan_licences(df).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]
    assert len({d for _, d in LONG_LICENCES}) == len(LONG_LICENCES)
