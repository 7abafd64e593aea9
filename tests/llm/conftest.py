import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, node long, label int"
#: names that operators would like for columns of their own
CLASHING = ("_score", "_some", "_size", "_copy", "_d", "_s", "_times", "_node", "_h", "_row", "keys", "score", "_k")
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "upsilon"]


def prose(n: int, seed: int) -> str:
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows and columns whose names operators use themselves."""
    rows = [(i, prose(40 + i, i), "en", f"s{i % 3}", 1, "x", 9, 1) for i in range(20)]
    rows += [
        (100, None, None, None, None, None, None, None), (101, "", "en", "s0", 0, "x", 1, 1), (102, " \t\n ", "en", "s1", 3, "x", 1, 1),
        (103, prose(30_000, 5), "en", "s2", 1, "x", 1, 1), (104, rows[3][1], "de", "s1", 1, "y", 2, 0), (5, rows[5][1], "en", "s2", 1, "x", 9, 1),
        (None, "a row without key", "fr", None, 1, "x", 1, 1), (105, "é𝛼ß ▁ tab\there " * 3, "fr", "s0", 1, "x", 1, 1), (106, "word", "en", "s0", 4, "x", 1, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def none_at_all(spark):
    return spark.createDataFrame([], SCHEMA)
