"""Blocks that hold few words."""

from __future__ import annotations

import numpy as np
import pytest

from panelvar.llm import substrings


@pytest.mark.parametrize("n", range(41))
def test_anchors_of_few_words(n):
    words = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    h, at = substrings._anchors(words, substrings.WINDOW, substrings.SHORT)
    span = substrings.WINDOW - substrings.SHORT + 1
    want = [k + int(np.argmin(h[k : k + span])) for k in range(max(n - substrings.WINDOW + 1, 0))]
    assert at.tolist() == want


def test_single_short_documents(spark):
    for n in (21, 27, 33, 40):
        docs = spark.createDataFrame([(n, " ".join(f"w{k}" for k in range(n)))], "doc_id long, text string")
        assert [(r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect()] == [(n, 0)]
