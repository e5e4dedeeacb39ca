from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from panelvar.llm import contamination
from tests.llm.conftest import sentence

ITEM_SCHEMA = "item_id long, text string, doc_id long, items string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def item_rows(docs_rows):
    rng = random.Random(8)
    texts = [r[1] for r in docs_rows]
    long_one = max((t for t in texts if t), key=len).split()
    rows = [
        (3, " ".join(long_one[50:75])),
        (12, " ".join(long_one[50:75]).upper() + "!"),
        (101, sentence(rng, 5) + " " + " ".join(long_one[5990:])),
        (4, "one two three four"),
        (5, "again and"),
        (6, "Again"),
        (7, "again and again and again and again and again and again"),
        (8, None), (9, ""), (10, " . , "), (11, sentence(rng, 40)),
        (None, " ".join(texts[20].split()[:12])), (3, " ".join(texts[25].split()[-11:])),
        (13, "ÜNÏ ünï cödé"), (14, "ünï cödé ÀÉ"),
    ]
    rows += [(200 + k, " ".join(texts[10].split()[k : k + 10])) for k in range(6)]
    return rows


def brute(text, items, window, slop):
    words = cut(text)
    hit, found, near, every = set(), set(), set(), set(words)
    for item_id, body in items:
        own = cut(body)
        m = min(window, len(own))
        for k in range(len(own) - m + 1) if own else ():
            phrase = own[k : k + m]
            for at in range(len(words) - m + 1):
                if words[at] == phrase[0] and words[at : at + m] == phrase:
                    hit.update(range(at, at + m))
                    found.add(str(item_id))
            wanted = set(phrase)
            for at in range(len(words)) if wanted <= every else ():
                if words[at] in wanted and wanted <= set(words[at : at + m + slop]):
                    near.add(str(item_id))
    found.discard("None"), near.discard("None")
    return len(words), len(hit), tuple(sorted(found)), tuple(sorted(near))


@pytest.mark.parametrize("shard_words,block_words", [(1 << 21, 1 << 20), (300, 40)])
def test_equals_brute_force(spark, docs, docs_rows, shard_words, block_words):
    items = item_rows(docs_rows)
    table = spark.createDataFrame([(a, b, 1, "x") for a, b in items], ITEM_SCHEMA)
    got = contamination.contaminated(docs, table, slop=3, shard_words=shard_words, block_words=block_words).collect()
    want = Counter((r[0], *brute(r[1], items, 10, 3)) for r in docs_rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(r["near"])) for r in got) == want
    assert any(len(r["near"]) > len(r["items"]) for r in got)


def test_one_span_per_stretch_and_text(spark):
    docs = spark.createDataFrame([(1, "a b c x a b c"), (2, "a b c"), (3, "a b c")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in contamination.contaminated(docs, items).collect()}
    assert got == {1: [(0, 3), (4, 7)], 2: [(0, 3)], 3: [(0, 3)]}


def test_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame([], ITEM_SCHEMA)
    assert contamination.contaminated(no_docs, items).collect() == []
    assert all(r["n_hit"] == 0 and not r["items"] for r in contamination.contaminated(docs, items).collect())


def test_frequent_words_are_searched_in_steps(monkeypatch):
    monkeypatch.setattr(contamination, "STEP", 7)
    rng = np.random.default_rng(2)
    words, edges = rng.integers(0, 3, 500).astype(np.uint64), np.array([0, 120, 120, 500])
    own = rng.integers(0, 3, 60).astype(np.uint64)
    block = contamination.Block(["i"], own, np.array([0, 60]), 5)
    search = contamination.Search(contamination.Shard.of(words, edges), block)
    got = sorted((tuple(p), int(s)) for phrases, starts in search.exact(5) for p, s in zip(block.terms[block.rows(5, phrases)], starts))
    phrases = {tuple(own[k : k + 5]) for k in range(56)}
    want = sorted((tuple(words[k : k + 5]), k) for k in range(496) if tuple(words[k : k + 5]) in phrases and not 115 < k < 120)
    assert got == want
