import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


#: nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names the operators use
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, `_id` long, text_hash string, score double, kept string"


def rows() -> list[tuple]:
    long = prose(1, 60_000)
    near = prose(2, 200)
    texts = [None, "", "   \n", "one", "One  two", "a b c d e", "A b\tc d E", prose(3, 40), prose(3, 40), near, near + " more", near.upper(), long, long + "!", "word " * 500, "xyz" * 30_000, "日本語 テキスト", "naïve café ΣΣ İ"]
    out = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], len(t or ""), i, "r", i, "h", 0.5, "k") for i, t in enumerate(texts)]
    return [*out, out[7], out[0], (None, "no id", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
