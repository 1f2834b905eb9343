from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, odd texts."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts: list[str | None] = [prose(rng.randint(5, 120)) for _ in range(40)]
    base, passage = prose(80), prose(60)
    for i in range(25):
        w = base.split()
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [base.upper(), base, base]
    texts += [f"{prose(20)}\n{passage}\n{prose(20)}" for _ in range(15)]
    texts += [None, "", "   ", "\n", "a", "a b", "A B", "a b c d", "a b c d e", "x\x1cy z", "é è ñ 日本 語", "a " * 300, "a" * 500, prose(3000), passage, prose(9) + " tail", "same", "same"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
