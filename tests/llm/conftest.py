from __future__ import annotations

import random

import pytest


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", " ", ". ", "\n", "  ", "\t"]) for w in words)


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text, source) rows with copies, near copies, shared passages, nulls, empty and long texts, repeats."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(0, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    texts += [texts[3], texts[3], texts[5] + " tail", passage + texts[7], texts[8] + passage, prose(rng, 10) + passage + prose(rng, 10)]
    near = prose(rng, 300).split(" ")
    for i in range(6):
        copy = list(near)
        copy[10 * i] = "changed%d" % i
        texts.append(" ".join(copy))
    texts += [None, "", " \t\n", "one", "one two three", "É naïve ÇA ß 日本語 text", prose(rng, 6000), "a " * 40]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    return rows + [(4, texts[4], "s1"), (None, texts[9], None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
