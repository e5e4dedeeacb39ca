from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from panelvar.llm import substrings


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window,short", [(35, 16), (6, 3)])
def test_equals_brute_force(docs, docs_rows, window, short):
    rows = substrings.remove_repeats(docs, window=window, short=short).collect()
    want = Counter(zip([r[0] for r in docs_rows], brute([r[1] for r in docs_rows], window)))
    assert Counter((r["doc"]["doc_id"], (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in rows) == want
    for r in rows:
        assert r["n_removed"] == sum(b - a for a, b in r["spans"])
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_rolled_hash_depends_on_the_window_alone():
    words = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    words[200:240] = words[20:60]
    h = substrings.rolled(words, 35, substrings.BASES[0])
    assert (h[200:206] == h[20:26]).all() and len(np.unique(h)) == len(h) - 6


def test_no_documents(no_docs):
    assert substrings.remove_repeats(no_docs).collect() == []
