import os

import duckdb
import pytest

from quire.llm import licenses, queries

MIT = licenses.TEXTS["MIT"][0]


def found(spark, texts):
    frame = spark.createDataFrame([(k, t, "l") for k, t in enumerate(texts)], "doc_id long, text string, licence string")
    return {r.doc_id: (r.licence, r.notices) for r in licenses.find(frame).collect()}


def test_variants_of_a_text(spark):
    wrapped = "MIT License\n\nCopyright (c) 2024 Some One\nCopyright 2025 Others, Inc.\nAll rights reserved.\n\n" + MIT.replace(", ", ",\n    ").replace('"', "“")
    texts = [MIT, MIT.upper(), wrapped, "// " + MIT.replace("\n", "\n// "), MIT + " Not.", licenses.TEXTS["ISC"][1].replace("copyright holder", "copyright owner"), licenses.TEXTS["BSD-3-Clause"][0].replace("copyright holder", "copyright owner")]
    got = found(spark, texts)
    assert [got[k][0] for k in range(7)] == ["MIT", "MIT", "MIT", "MIT", None, "ISC", "BSD-3-Clause"]


def test_notices(spark):
    texts = ["text\nReleased under the MIT Licence.\nmore\n  LICENSED UNDER CC BY-NC 4.0", "# SPDX-License-Identifier: Apache-2.0", "we licensed under the counter", None, "", "...", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License."]
    got = found(spark, texts)
    assert [got[k][1] for k in range(8)] == [["CC-BY-NC-4.0", "MIT"], ["Apache-2.0"], [], [], [], [], ["GPL-3.0"], ["MIT"]]
    assert found(spark, []) == {}


def test_long_and_repeated_texts(spark):
    long = MIT + " word" * 200_000
    assert found(spark, [long, MIT, MIT]) == {0: (None, []), 1: ("MIT", []), 2: ("MIT", [])}


def test_query_agrees_with_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    expected = con.execute(queries.oracle_sql()["op6_licenses"]).fetchall()
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in queries.op6_licenses(spark, small).collect())
    plan = queries.op6_licenses(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_further_texts(spark):
    long = "Long Licence\nVersion 9\n" + "terms and conditions " * 500
    frame = spark.createDataFrame([(0, long.upper()), (1, MIT), (2, "else")], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licenses.find(frame, more=[("Long-9", long), ("Mine", MIT)]).collect()}
    assert got == {0: "Long-9", 1: "MIT", 2: None}


def test_planted_texts_are_found(spark, small):
    got = {r.doc_id: r.licence for r in queries.op6_licenses(spark, small).where("doc_id < 0").collect()}
    names = [name for name, texts in licenses.TEXTS.items() for _ in texts for _ in (0, 1)]
    assert got == {-1 - k: name for k, name in enumerate(names)}


FILES = {"Apache-2.0": "Apache-2.0", "Artistic-1.0": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_long_licences(spark):
    texts, expected = [], []
    for name, file in FILES.items():
        with open(f"/usr/share/common-licenses/{file}", encoding="utf-8") as f:
            text = f.read()
        texts += [text, text.upper(), " \n\n".join(text.split("\n")), "/* " + text.replace("\n", "\n * ") + " */", text + "\nand more"]
        expected += [name] * 4 + [None]
        if "END OF TERMS AND CONDITIONS" in text:
            texts.append(text[: text.index("END OF TERMS AND CONDITIONS") + 27])
            expected.append(name)
    got = found(spark, texts)
    assert [got[k][0] for k in range(len(texts))] == expected


def test_holders_are_one(spark):
    bsd = licenses.TEXTS["BSD-3-Clause"][0]
    named = bsd.replace("the name of the copyright holder", "the name of Example Widgets, Inc.").replace("PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "PROVIDED BY EXAMPLE WIDGETS AND ITS FRIENDS").replace("SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE", "SHALL EXAMPLE WIDGETS BE")
    assert named.count("xample") + named.count("EXAMPLE") == 3
    assert found(spark, [named, named.replace("endorse", "praise")]) == {0: ("BSD-3-Clause", []), 1: (None, [])}


def test_altered_texts_match_nothing(spark):
    """Each known text with one word changed, further lines that look like claims, and clauses that name no holder."""
    texts = []
    for known in licenses.TEXTS.values():
        words = known[0].split(" ")
        for k in range(0, len(words), 7):
            texts.append(" ".join([*words[:k], "other", *words[k + 1 :]]))
    texts += [MIT + "\n(c) and you owe us everything, forever", "(c) you shall pay\n" + MIT, MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ANYONE OTHER THAN THE USER"), MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ANY USER"), "All rights reserved, and you pay.\n" + MIT, "Copyright 2024 " + "x " * 100 + "you owe us\n" + MIT]
    if os.path.isdir("/usr/share/common-licenses"):
        with open("/usr/share/common-licenses/Apache-2.0", encoding="utf-8") as f:
            apache = f.read()
        assert "(c) You must retain" in apache
        texts += [apache.replace("(c) You must retain", "(c) You need not retain"), apache.replace("perpetual", "temporary", 1)]
    assert [texts[k] for k, x in found(spark, texts).items() if x[0] is not None] == []


def test_claims_are_no_clauses(spark):
    texts = ["(c) 2024 Some One\n" + MIT, "Copyright (c) <year> <holders>\n" + MIT, "© 2020-2024 Ümlaut GmbH\nAll rights reserved.\n" + MIT, "Copyright by Some One\n\n" + MIT]
    assert [x[0] for _, x in sorted(found(spark, texts).items())] == ["MIT"] * 4


def test_names_that_clash(spark):
    frame = spark.createDataFrame([(1, MIT, "a", "b", "c", "d", "e")], "doc_id long, text string, _digest string, _licence string, _new string, __Held string, LICENCE string")
    made = licenses.find(frame)
    assert made.columns == ["doc_id", "text", "_digest", "_licence", "_new", "__Held", "digest", "licence", "notices"]
    assert made.first()[2:6] == ("a", "b", "c", "d") and made.first()["licence"] == "MIT"
