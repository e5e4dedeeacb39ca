from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelvar.llm import packing

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def packed(docs):
    return packing.pack(docs, packing.public_vocabulary(), capacity=64, with_ids=True).collect()


def test_ids_are_those_of_the_tokenizer(packed, docs_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_vocabulary()[0])
    want = Counter()
    for row in docs_rows:
        ids = np.array([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2], "<u4")
        total = len(ids)
        edges = [0, *range(total % 64 or 64, total + 1, 64)] if total > 64 else [0, total]
        want.update((row[0], n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(edges, edges[1:])))
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    assert got == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in packed)


def test_sequences_are_gapless_and_bounded(packed):
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("sizes", [[300] * 90, [10] * 700, list(range(1, 513)), [512, 513] * 40])
def test_best_fit_is_near_the_least(spark, sizes):
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, load long").repartition(3)
    rows = packing.place(items).collect()
    assert sorted(r["item"] for r in rows) == list(range(len(sizes)))
    load = Counter()
    for r in rows:
        load[r["sequence_id"]] += sizes[r["item"]]
    assert max(load.values()) <= 1024
    gaps, bins = [], 0
    for s in sorted(sizes, reverse=True):  # best fit, one by one
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            bins += 1
            gaps.append(1024 - s)
    assert len(load) <= bins * 1.06 + 1


def test_no_documents(no_docs):
    assert packing.pack(no_docs, packing.public_vocabulary()).collect() == []
