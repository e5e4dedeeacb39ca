from __future__ import annotations

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from panelvar.llm import repetition


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        k = q
        while k < n:
            if words[k] != words[k - q]:
                k += 1
                continue
            end = k
            while end < n and words[end] == words[end - q]:
                end += 1
            start, length = k - q, end - k + q
            if length >= max(24, 3 * q):
                found.setdefault((start, length), q)  # the smallest period comes first
            k = end
    return sorted(((s, n_, q) for (s, n_), q in found.items()), key=lambda r: (r[0], r[2]))


def sample(rng):
    words = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(0, 90))]
    for _ in range(rng.randrange(0, 4)):
        unit = [rng.randrange(rng.choice([2, 4, 60])) for _ in range(rng.randrange(1, 40))]
        much = int(len(unit) * rng.uniform(2.5, 6)) + rng.randrange(0, 25)
        at = rng.randrange(0, len(words) + 1)
        words[at:at] = (unit * (much // len(unit) + 1))[:much]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = sample(rng)
        assert repetition.runs(np.array(words, np.int64)) == brute(words), words


def test_nested_periods():
    unit = [1] * 30 + [2]
    words = unit * 5 + [3] + [4, 5] * 200
    assert repetition.runs(np.array(words)) == brute(words)


def test_time_does_not_grow_with_the_square():
    words = np.array(([1, 2, 3] * 100_000) + list(range(4, 50_004)))
    assert repetition.runs(words) == [(0, 300_000, 3)]


def test_table(spark, docs, docs_rows):
    got = repetition.periodic_runs(docs).collect()

    def one(text):
        words = (text or "").encode().split()
        runs = brute(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        return tuple(runs), best, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()

    want = Counter((r[0], one(r[1])) for r in docs_rows)
    assert Counter((r["doc_id"], (tuple(map(tuple, r["runs"])), tuple(r["best"]) if r["best"] else None, r["collapsed"])) for r in got) == want
    assert any(r["runs"] for r in got)


def test_query_alters_one_text_in_ten(spark, tmp_path):
    import zlib

    rng = random.Random(9)
    rows = [(k, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 120)))) for k in range(200)]
    rows += [(200, None), (201, ""), (202, "\t \n"), (None, "a b c"), (204, "x " * 60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in repetition.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    altered = 0
    for doc_id, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            altered += 1
        runs = brute(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        r = got[doc_id]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert altered > 10


def test_no_documents(no_docs):
    assert repetition.periodic_runs(no_docs).collect() == []
