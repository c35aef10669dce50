import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long"

#: Nulls, empty and odd texts, ties, repeated rows; the last two columns clash with the operators' own names.
EDGE = [
    (1, None, "en", "a", None),
    (None, "the cat sat on the mat and the dog", "en", None, 3),
    (2, "", None, "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "same text here for you", "en", "b", 4),
    (4, "same text here for you", "en", "b", 4),
    (5, "same text here for you", "en", "b", 4),
    (6, "<|endoftext|> don't é漢 \U0001f600 ²½ \x1c z", "fr", "c", 4),
    (7, "1 2 3 4 5", None, "c", 4),
]


def long_text(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()) for _ in range(n))


@pytest.fixture(scope="session")
def edge(spark):
    rows = [*EDGE, (8, "x" * 60_000, "en", "c", 1), (9, long_text(30_000, 1), "en", "c", 1)]
    return spark.createDataFrame([(*r, 0.5, 7) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
