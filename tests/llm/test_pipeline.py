from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_near import brute

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.choice((2, 3, 4, 5, 6, 8)))) for _ in range(800)]
    rows = []
    for k in range(240):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 20))) for _ in range(rng.randint(3, 8))]
        if k % 4 == 0:
            lines.insert(1, "Sign up for our letter today.")
        text = "\n".join(lines)
        if k % 10 == 9:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
    rows += [(1000 + k, rows[k][1], "en", f"s{k % 3}", rows[k][4]) for k in range(0, 60, 3)]
    rows += [(2000 + k, rows[k][1] + " tail", "en", "s1", 0) for k in range(1, 40, 3)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s0", 0), (None, rows[5][1], None, None, None)]
    return rows


def test_stages_act_on_what_the_one_before_kept(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
        if k < 4:
            assert docs.dtypes == [tuple(x.split()) for x in SCHEMA.replace("long", "bigint").split(", ")]
    ids = {name: Counter(r["doc_id"] for r in found) for name, found in seen.items()}
    assert all((k in ids["quality_rules"]) == (k % 10 != 9) for k in range(240)) and 3000 not in ids["quality_rules"]
    assert ids["line_dedup"] == ids["quality_rules"]
    assert not any("Sign up" in r["text"] for r in seen["line_dedup"])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"])
    groups = brute([(r["doc_id"], r["text"]) for r in seen["line_dedup"]])
    assert ids["near_dedup"] == Counter({i: n for (i, _, _, kept), n in groups.items() if kept})
    assert set(ids["source_mixing"]) <= set(ids["near_dedup"]) and max(ids["source_mixing"].values()) <= 2
    pieces = seen["best_fit_packing"]
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == ids["source_mixing"]
    load = Counter()
    for r in pieces:
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= 1024
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(r["doc_id"] for r in pieces)
