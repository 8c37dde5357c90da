import random

import pytest

WORDS = "the of and to in stone river garden window letter yellow harbour engine silver market winter".split()


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from texts, with columns whose names operators use themselves."""

    def make(texts, first=0, ids=None):
        rows = [(i, t, "en", f"src{k % 3}", len(t or ""), 7, "x", 0.5, 1) for k, (i, t) in enumerate(zip(ids or range(first, first + len(texts)), texts, strict=True))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, key string, score double, n int")

    return make


@pytest.fixture(scope="session")
def prose():
    def make(n, seed=0):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))

    return make
