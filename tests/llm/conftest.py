from __future__ import annotations

import random

import pytest
from odd_rows import SCHEMA, document

@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(12)]
    rows = [document(k, t) for k, t in enumerate(prose)]
    rows += [document(20, None), document(21, ""), document(22, " \t\n"), document(23, "!!! 123 ..."), document(24, "word"), document(25, "x" * 200_000)]
    rows += [document(26, " ".join(rng.choice(words) for _ in range(60_000))), document(27, prose[0]), document(28, prose[0] + " tail of it"), document(29, "début ÉTÉ naïve 日本語 текст 🙂"), document(30, None, None)]
    rows += [document(3, prose[3])] * 2 + [document(None, prose[4]), document(None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
