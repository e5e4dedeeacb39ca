from __future__ import annotations

from panelvar.llm import hosts

SCHEMA = "page_id long, url string, host string, verdict string, share double"


def test_rules_and_parts(spark):
    cases = [
        ("http://A.Example.ORG/en/1x?q#f", "a.example.org", "/en/1x", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("https://x.example.org/es/", "x.example.org", "/es/", "example.org/es/", "block"),
        ("ftp://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://org/es", "org", "/es", "org/", "allow"),
        ("http://b.com/de/x", "b.com", "/de/x", "com/de/", "block"),
        ("http://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
        ("http://b.com", "b.com", "", None, "allow"),
        ("http://b.org?x=/es/", "b.org", "", None, "allow"),
        ("x://h/p://q", "h", "/p://q", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, c[0], "h", "v", 0.0) for k, c in enumerate(cases)] + [(0, cases[0][0], "h", "v", 0.0)], SCHEMA)
    none = spark.createDataFrame([], "host string, bad boolean")
    rows = hosts.judge(pages, none).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        assert (r["doc"]["url"], r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["doc"]["page_id"]]


def test_reputation_needs_evidence(spark):
    outcomes = [("bad.one.net", True)] * 40 + [("bad.one.net", False)] * 2 + [("good.one.net", False)] * 60 + [("once.two.net", True)]
    outcomes += [(f"h{k}.net", k % 9 == 0) for k in range(200)] + [(None, True), ("good.one.net", None)]
    table = spark.createDataFrame(outcomes, "host string, bad boolean")
    urls = ["http://bad.one.net/", "http://good.one.net/", "http://once.two.net/", "http://new.one.net/"]
    pages = spark.createDataFrame([(k, u, "h", "v", 0.0) for k, u in enumerate(urls)], SCHEMA)
    rows = {r["host"]: r for r in hosts.judge(pages, table).collect()}
    assert [rows[u[7:-1]]["verdict"] for u in urls] == ["block", "allow", "allow", "allow"]
    assert rows["good.one.net"]["share"] < rows["new.one.net"]["share"] < rows["bad.one.net"]["share"]
    assert hosts.judge(pages.limit(0), table).collect() == []
