import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, kept boolean, node long, h1 string"


def make_docs(spark, rows, schema=DOC):
    """Documents from (doc_id, text[, lang[, source]]) with extra columns of clashing names."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *([None] * (4 - len(r))))
        full.append((doc_id, text, lang, source, len(text or ""), 0.5, 7, None, -1, "x"))
    return spark.createDataFrame(full, schema)


@pytest.fixture
def vocabulary():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


@pytest.fixture
def passage(vocabulary):
    """passage(seed, n): n words drawn from the vocabulary."""

    def draw(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    return draw
