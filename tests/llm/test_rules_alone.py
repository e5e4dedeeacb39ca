"""Each repeat statistic rejects by itself; texts with a few repeats stay."""

from __future__ import annotations

import math
import random

from panelvar.llm import rules

from .test_rules import mixed


def shuffled_lines(rng: random.Random, distinct: int, times: int) -> str:
    lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice((2, 3, 4, 5, 7, 9)))) for _ in range(3)) for _ in range(distinct)] * times
    rng.shuffle(lines)
    return "\n".join(lines)


def test_limit_is_a_chi_square_quantile():
    half = rules.LIMIT**2 / 2
    assert math.isclose(math.exp(-half) * (1 + half), rules.TAIL, rel_tol=1e-4)
    assert 1 / rules.FLOORS[2] > rules.LIMIT and math.sqrt(rules.MOST_REPEAT_PERCENT / 100) / rules.FLOORS[3] > rules.LIMIT


def test_shuffled_repeated_lines_go_and_a_few_repeats_stay(spark):
    rng = random.Random(7)
    rows = mixed(600, 0)
    rows += [(1000 + k, shuffled_lines(rng, 40, 4), "en", "big") for k in range(6)]
    once = [shuffled_lines(rng, 40, 1).split("\n") for _ in range(6)]
    rows += [(2000 + k, "\n".join(x + [x[5], x[20]]), "en", "big") for k, x in enumerate(once)]
    out = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)).collect()
    assert all(not r["base_failed"] for r in out)
    assert {r["doc"]["doc_id"] for r in out if not r["kept"]} == {1000 + k for k in range(6)}
