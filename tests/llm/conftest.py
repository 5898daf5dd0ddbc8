import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, words string, sig long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "straße", "漢字", "été", "x1", "it's"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(30_000)
    rows = [
        (1, text(40), "en", "a", 1, 9, 0.1, "w", 7), (2, None, None, None, None, None, None, None, None), (3, "", "en", "a", 0, 9, 0.1, "w", 7), (4, " \n\t ", "de", "b", 4, 1, 0.2, "v", 8), (5, long, "en", "a", len(long), 2, 0.3, "u", 9), (6, long, "en", None, len(long), 2, 0.3, "u", 9),
        (None, text(30), "fr", "b", 3, 3, 0.4, "t", 1), (1, text(40), "en", "a", 1, 9, 0.1, "w", 7), (8, "password = hunter2secret MIT License <|endoftext|>", "en", "a", 5, 4, 0.5, "s", 2), (8, "password = hunter2secret MIT License <|endoftext|>", "en", "a", 5, 4, 0.5, "s", 2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
