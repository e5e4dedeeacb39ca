from __future__ import annotations

from collections import defaultdict

import pytest

from panelvar.llm import lines

SCHEMA = "doc_id long, source string, text string, h string, k long, bad string, lines string"
WHITE = " \t\n\x0b\x0c\r"


def fixture():
    rows = []
    for k in range(40):
        body = [f"own line {k}", "Cookies, please."] if k % 2 else [f"own line {k}", " "]
        rows.append((k, "a" if k < 30 else None, "\n".join([*body, f"end {k} "]), "x", 1, "y", "z"))
    rows += [(100 + k, "a", "copied page\nits line", "x", 1, "y", "z") for k in range(30)]
    rows += [(200, "b", None, "x", 1, "y", "z"), (201, "b", "", "x", 1, "y", "z"), (202, None, "  Cookies, please.\t\nx", "x", 1, "y", "z")]
    return rows + rows[:2]


@pytest.mark.parametrize("limit", [200_000, -1])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_HOSTS", limit)
    rows = fixture()
    contents, on = defaultdict(set), defaultdict(set)
    for _, source, text, *_ in rows:
        if text is not None:
            contents[source].add(text)
            for line in text.split("\n"):
                on[source, line.strip(WHITE)].add(text)
    want = []
    for i, source, text, *_ in rows:
        kept = None
        if text is not None:
            bad = lambda x: x.strip(WHITE) and len(on[source, x.strip(WHITE)]) >= 5 and 10 * len(on[source, x.strip(WHITE)]) > len(contents[source])
            kept = "\n".join(x for x in text.split("\n") if not bad(x))
        want.append((i, kept))
    out = lines.drop_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    key = lambda x: (x[0], x[1] or "")
    assert sorted(((r["doc"]["doc_id"], r["doc"]["text"]) for r in out), key=key) == sorted(want, key=key)
    assert sum(r["n_dropped"] for r in out) == 22
    assert all(r["doc"]["text"] == "copied page\nits line" for r in out if 100 <= r["doc"]["doc_id"] < 200)


def test_no_documents(spark):
    assert lines.drop_lines(spark.createDataFrame([], SCHEMA)).collect() == []
