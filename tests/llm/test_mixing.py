from __future__ import annotations

import re
from collections import defaultdict
from fractions import Fraction

import pytest

from panelvar.llm import mixing
from panelvar.llm.shared import Scratch, word_count


def target_by_resharing(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, out, free = Fraction(3, 2) * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            out.update(share)
            break
        for s in above:
            out[s] = Fraction(2 * sizes[s])
            free.remove(s)
    return out


def test_targets_and_mix(docs, docs_rows):
    sizes = defaultdict(int)
    for r in docs_rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = target_by_resharing(sizes)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(docs_rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        source = r["doc"]["source"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["doc"]["text"] or ""))
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(float(want[source]), rel=1e-12)
        assert r["taken"] == r["size"] * r["times"] and r["times"] in (0, 1, 2)
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    for source, words in taken.items():
        assert abs(words - want[source]) <= 2 * largest[source]
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r["doc"]["doc_id"] is None, r["doc"]["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, again), key=str) == sorted(map(key, rows), key=str)


def test_refinement_ends_at_the_nearest_document(spark):
    rows = [(k, f"s{k % 7}", "w " * (1 + k % 13)) for k in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for s in range(7):
        mine = [r for r in out if r["doc"]["source"] == f"s{s}"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 13 / 2


def test_no_documents_and_no_words(spark, no_docs):
    assert mixing.mix(no_docs).collect() == []
    rows = mixing.mix(spark.createDataFrame([(1, "a", None), (None, None, "")], "doc_id long, source string, text string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_word_count(spark):
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    texts = [None, "", space, "a", " a", "a ", f"{space}a{space}{space}b{space}", "a\x1cb\u3000c\x85d e", "ü\x00 \\ $1 x\n\nx", *(f"a{x}{y}b" for x in space for y in space)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", word_count("text").alias("n")).collect()
    assert [r["n"] for r in rows] == [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]


def test_a_row_per_source_is_one_file(spark, monkeypatch):
    """The plan has 20 rows; with many shuffle partitions it was written by 20 tasks in every step."""
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, *a, **k: saved.append(save(self, *a, **k)) or saved[-1])
    held = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        rows = [(k, f"s{k % 20}", "w " * (1 + k % 13)) for k in range(2000)]
        out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(out) == 2000 and len(saved) > 2
    assert [len(t.inputFiles()) for t in saved[1:]] == [1] * (len(saved) - 1)


def test_many_sources_without_broadcast(spark, docs, monkeypatch):
    key = lambda r: (r["doc"]["doc_id"], r["size"], r["source_size"], r["target"], r["taken"])
    few = sorted(map(key, mixing.mix(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 2)
    assert sorted(map(key, mixing.mix(docs).collect()), key=str) == few
