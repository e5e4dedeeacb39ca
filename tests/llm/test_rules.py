from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from panelvar.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    gone = [False] * len(words)
    for k in range(len(words) - 7):
        if seen[tuple(words[k : k + 8])] > 1:
            gone[k : k + 8] = [True] * 8
    inked = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * sum(gone) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(inked) - len(set(inked)), sum(gone), failed


def test_base_statistics_equal_brute_force(docs, docs_rows):
    rows = rules.judge(docs, keep_text=True).collect()
    got = Counter((r["doc"]["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == Counter((r[0], *base(r[1])) for r in docs_rows)
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert {r["doc"]["kept"] for r in rows} == {"no", None}


def mixed(n=600, junk=90):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice((2, 3, 4, 5, 7, 9)))) for _ in range(rng.randint(40, 300))]
        if k < junk:
            words = [w + "###" for w in words] if k % 2 else [w * 4 for w in words]
        lang, source = ("en", "big") if k % 3 else ("de", f"small{k % 5}")
        rows.append((k, " ".join(words), lang, source))
    return rows


def test_outliers_go_and_clean_texts_stay(spark):
    docs = spark.createDataFrame(mixed(), "doc_id long, text string, lang string, source string").repartition(4)
    kept = {r["doc"]["doc_id"]: r["kept"] for r in rules.judge(docs).collect()}
    assert not any(kept[k] for k in range(90)) and all(kept[k] for k in range(90, 600))


def test_estimate_equals_concentration_steps_in_numpy(spark):
    from pyspark.sql import functions as F

    from panelvar.llm.shared import Scratch

    docs = spark.createDataFrame(mixed(), "doc_id long, text string, lang string, source string")
    stats = rules.statistics(docs).where("NOT base_failed").select(*rules.vector())
    x = np.array(stats.collect(), float)
    got = rules.estimate(stats.withColumn("key", F.lit("all")), Scratch(spark, "test")).first()
    floors = np.diag((np.array(rules.FLOORS) * rules.UNIT) ** 2)
    quarter = np.percentile(x, [25, 75], axis=0)
    m, c = np.median(x, axis=0), np.diag(((quarter[1] - quarter[0]) / 1.349) ** 2) + floors
    for _ in range(rules.STEPS):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        bins = np.minimum(rules.BINS - 1, np.floor(np.log1p(d) * 16))
        before = np.array([(bins < b).sum() for b in bins])
        near = x[before * 100 < len(x) * rules.CORE_PERCENT]
        m, c = near.mean(axis=0), np.cov(near.T, bias=True) * rules._consistency(0.75) + floors
    low = np.array([[got[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    assert np.allclose([got[f"m{i}"] for i in range(4)], m, rtol=1e-6)
    assert np.allclose(low @ low.T, c, rtol=1e-5, atol=1e-3)


def test_no_documents(no_docs):
    assert rules.judge(no_docs).collect() == []
