import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copy int, component_id long, host string, label int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeats, ties, and extra columns whose names clash with those that
    the operators use."""
    rng = random.Random(0)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = "\n".join(text(12) + "." for _ in range(900))
    rows = [(1, text(60), "en", "s0"), (2, None, "en", "s0"), (3, "", None, "s1"), (4, "   \n\t ", "en", None), (5, long, "en", "s0"), (6, "日本語 のテキスト。" * 30, "ja", "s1"), (7, "é" * 50, None, None)]
    rows += [(8, rows[0][1], "en", "s0"), (8, rows[0][1], "en", "s0"), (None, text(40), "en", "s0"), (None, None, None, None), (9, "x", "en", "s1"), (10, "w" * 5000, "en", "s1")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 0.5, 9, -1, "h", 3) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
