from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, key long, host string, kept string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))


def corpus() -> list[tuple]:
    """Documents with nulls, empty and long texts, repeated rows, copies and near copies, and extra
    columns whose names the operators use themselves."""
    rng = random.Random(5)
    passage = sentence(rng, 60)
    texts: list[str | None] = [None, "", " \t\n ", "one", "one two three four", "one two three four", "ONE two three Four"]
    for _ in range(30):
        texts.append("\n".join(sentence(rng, rng.randint(8, 40)) for _ in range(rng.randint(1, 6))))
    base = sentence(rng, 200)
    for k in range(8):  # near copies in a chain: each a few words off the one before
        words = base.split()
        for j in range(k):
            words[10 + 20 * j] = f"changed{k}{j}"
        texts.append(" ".join(words))
    texts += [texts[10]] * 5
    texts += [sentence(rng, 30) + " " + passage + "\n" + sentence(rng, 30) for _ in range(4)]
    texts += [sentence(rng, 6000), ("again and again " * 30).strip(), "ünï cödé ÀÉ x <|endoftext|> y", "a  b\r\n c\x1cd 　e"]
    rows = []
    for k, text in enumerate(texts):
        source = None if k % 11 == 0 else "hot" if k % 2 else f"s{k % 5}"
        rows.append((k * 7 % 101, text, "en" if k % 3 else None, source, 1, "x", "y", k, "z", "no"))
    rows.append((None, texts[12], None, None, None, None, None, None, None, None))
    rows += [rows[9], rows[9], rows[13]]
    return rows


@pytest.fixture(scope="session")
def docs_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
