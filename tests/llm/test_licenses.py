from __future__ import annotations

from panelvar.llm import licenses

SCHEMA = "doc_id long, text string, licence string, known string, s string"


def test_sentences_and_ordered_rules(spark):
    mit = licenses.SENTENCES[6] + " " + licenses.SENTENCES[7]
    cases = [
        (mit, "6,7", "mit", ["mit"]),
        ("Some text.\nReleased  under the MIT\nlicense.\nMore. ALL RIGHTS RESERVED!", "1,5", "mit", ["mit", "all-rights-reserved"]),
        (licenses.SENTENCES[9] + "\n" + licenses.SENTENCES[8] + "\n" + licenses.SENTENCES[10], "9,8,10", "bsd-3-clause", ["bsd-3-clause", "bsd-2-clause"]),
        (licenses.SENTENCES[10] + " " + licenses.SENTENCES[9], "10,9", "bsd-2-clause", ["bsd-2-clause"]),
        (licenses.SENTENCES[15] + " " + licenses.SENTENCES[16], "15,16", "gpl-3.0-or-later", ["gpl-3.0-or-later"]),
        (licenses.SENTENCES[5] * 2 + " " + licenses.SENTENCES[5], "5", "all-rights-reserved", ["all-rights-reserved"]),
        ("prose " * 9000 + ". " + licenses.SENTENCES[2] + " end", "2", "apache-2.0", ["apache-2.0"]),
        ("nothing here", "", None, []),
        ("", "", None, []),
        (None, "", None, []),
    ]
    docs = spark.createDataFrame([(k, c[0], "x", "y", "z") for k, c in enumerate(cases)] * 2, SCHEMA)
    rows = licenses.scan(docs).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        want = cases[r["doc"]["doc_id"]]
        assert (r["doc"]["text"], r["sentence_ids"], r["licence"], r["licences"]) == want
    assert licenses.scan(docs.limit(0)).collect() == []


def test_every_known_sentence_is_one_sentence(spark):
    docs = spark.createDataFrame([(n, s, "", "", "") for n, s in licenses.SENTENCES.items()], SCHEMA)
    assert {r["doc"]["doc_id"]: r["sentence_ids"] for r in licenses.scan(docs).collect()} == {n: str(n) for n in licenses.SENTENCES}
