import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, ids string, spans string, n int, score double, row string, again int, copies int, common string, h long"


def rows_of(texts, **more):
    return [(i, t, "en", f"s{i % 3}", len(t or ""), 1, "x", "y", 2, 0.5, "r", 7, 8, "c", 9) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and columns named as the operators name theirs."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(30)]
    texts = [None, "", " \n\t ", "a", "x" * 30_000, " ".join(["same words here again"] * 3_000), "1" * 20_000, "a@b.example.com +1 (555) 010-2030 10.0.0.1", *prose, *prose[:5]]
    rows = rows_of(texts)
    rows += [rows[8], rows[8], (None, prose[0], None, None, None, *[None] * 10), (None, None, None, None, None, *[None] * 10), (900, prose[1], None, "s1", None, *[None] * 10)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
