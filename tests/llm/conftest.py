import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, alphabet="abcdefgh"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def rng():
    return random.Random(3)


@pytest.fixture
def frame(spark):
    """Builds a table of documents from (doc_id, text[, lang, source])."""

    def make(rows, extra=""):
        full = []
        for r in rows:
            r = tuple(r) + (None,) * (4 - len(r))
            full.append((*r, None if r[1] is None else len(r[1])))
        df = spark.createDataFrame(full, DOCS)
        if extra:  # columns whose names the operators use themselves
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(f"own {c}") for c in extra.split()})
        return df

    return make
