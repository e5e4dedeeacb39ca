from __future__ import annotations

from panelvar.llm import rules
from tests.llm.test_rules import mixed


def test_dealt_estimates_give_the_verdicts_of_sent_ones(spark, monkeypatch):
    docs = spark.createDataFrame(mixed(), "doc_id long, text string, lang string, source string").repartition(4)
    sent = {r["doc"]["doc_id"]: (r["kept"], r["distance"]) for r in rules.judge(docs).collect()}
    monkeypatch.setattr(rules, "BROADCAST_GROUPS", -1)
    assert {r["doc"]["doc_id"]: (r["kept"], r["distance"]) for r in rules.judge(docs).collect()} == sent
