"""Large groups of near copies with many pairs close to the limit: components equal those of all pairs."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from panelvar.llm import near
from tests.llm.test_near import brute


def group(rng: random.Random, n: int) -> list[str]:
    """Copies of one text with up to a third of the words changed, some with changes in common, some cut."""
    base = [f"v{rng.randint(0, 900)}" for _ in range(110)]
    families = []
    for _ in range(4):
        words = list(base)
        for at in rng.sample(range(110), 12):
            words[at] = f"f{rng.randint(0, 10**6)}"
        families.append(words)
    texts = [" ".join(base)]
    for k in range(n):
        words = list(rng.choice(families) if k % 3 == 0 else base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(110)] = rng.choice(["x", "y", f"n{rng.randint(0, 10**6)}"])
        if k % 4 == 0:
            words = words[rng.randint(0, 20) : 110 - rng.randint(0, 25)]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("few,centres", [(16, 3), (1, 1)])
def test_components_equal_those_of_all_pairs(spark, monkeypatch, few, centres):
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "CENTRES", centres)
    rng = random.Random(3)
    rows = list(enumerate(group(rng, 450) + group(rng, 60)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r["doc"]["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(docs).collect())
    want = brute(rows)
    assert len({r[2] for r in want}) > 20
    assert got == want


def test_members_of_many_keys_meet_one_centre_and_texts_stay(spark, monkeypatch):
    """Keys of one component share a centre, and the last join sends the numbers to the texts."""
    seen = []
    plain = near._open_pairs
    monkeypatch.setattr(near, "_open_pairs", lambda spokes: seen.append(spokes.select("a", "b").collect()) or plain(spokes))
    rng = random.Random(4)
    docs = spark.createDataFrame(list(enumerate(group(rng, 300))), "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = near.near_duplicates(docs)
        assert out.count() == 301 and "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    (pairs,) = seen
    assert len({p.a for p in pairs}) > 50 and len(pairs) <= 1.5 * len({p.a for p in pairs})


@pytest.mark.parametrize("keys", [near.BROADCAST_KEYS, -1])
def test_band_keys_move_once_at_most(spark, monkeypatch, keys):
    """The copies' numbers go to the texts; where they are too many, band keys are dealt once for both readers."""
    monkeypatch.setattr(near, "BROADCAST_KEYS", keys)
    dealt = []
    plain = near.Scratch.save

    def save(self, df, *args, **kwargs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt.append("bands" in plan and any("SortMergeJoin [key" in line and "LeftSemi" in line for line in plan.splitlines()))
        return plain(self, df, *args, **kwargs)

    monkeypatch.setattr(near.Scratch, "save", save)
    texts = group(random.Random(6), 60)
    rows = list(enumerate(texts + texts[:20] + texts[:3] * 5 + [None, "", "one two"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = near.near_duplicates(docs).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert Counter((r["doc"]["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == brute(rows)
    assert sum(dealt) == (0 if keys > 0 else 1)


@pytest.mark.parametrize("sent", [10**6, -1])
def test_rounds_of_labels_deal_rows_once(spark, monkeypatch, sent):
    """Few labels go to every task: a table of a round has one exchange by key; the driver keeps less. Earlier labels hold."""
    monkeypatch.setattr(near, "BROADCAST_LINKS", sent, raising=False)
    dealt = []
    plain = near.Scratch.save

    def save(self, df, *args, **kwargs):
        dealt.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return plain(self, df, *args, **kwargs)

    monkeypatch.setattr(near.Scratch, "save", save)
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(201, 200)]
    scratch = near.Scratch(spark, "labels")
    links = lambda rows: scratch.save(spark.createDataFrame(rows, "a bigint, b bigint"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = near.components(links(chain), scratch)
        assert {r["node"]: r["comp"] for r in found.collect()} == {k: 0 if k < 41 else 100 if k < 130 else 200 for k in [*range(41), *range(100, 130), 200, 201]}
        more = {r["node"]: r["comp"] for r in near.components(links([(129, 7), (300, 201)]), scratch, found).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(more.values()) == {0, 200} and more[120] == 0 and more[300] == 200 and len(more) == 74
    assert max(dealt) == (1 if sent > 0 else 5)
