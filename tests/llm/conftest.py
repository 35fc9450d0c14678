"""Small document tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, shard string"


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["the", "and", "of"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, shared = prose(150), prose(70)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, base.upper(), " ".join(near), shared + " " + prose(90), prose(80) + "\n" + shared, None, "", " \t\n", "one", "one two three",
             "one two three", prose(9000) + " " + shared, "x" * 20000, "mail me at a.b@c.example.org or +49 170 1234567 x" * 3, "same\nsame\nsame " + prose(60)]
    rows = [(i, t, None if i % 5 == 3 else "en" if i % 2 else "de", None if i % 7 == 2 else f"s{i % 3}", 0, "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[5], (None, base, "en", "s0", 0, "clash", None), (None, None, None, None, None, None, None)]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
