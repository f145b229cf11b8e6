import random

import pytest
from llm_helpers import make_docs, words


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages."""
    rng = random.Random(11)
    base = words(rng, 300)
    passage = words(rng, 60)
    near = [*base[:40], "changed", *base[41:]]
    rows = [
        (0, " ".join(base), "en", "a"), (1, " ".join(base), "en", "a"), (2, " ".join(near), "de", "b"), (3, None, None, None), (4, "", "en", "a"), (5, " \n\t ", "en", "b"),
        (6, " ".join([*words(rng, 20), *passage, *words(rng, 30)]), "de", None), (7, " ".join([*passage, *words(rng, 90)]), "en", "a"), (8, "one two three", None, "b"),
        (9, " ".join(words(rng, 20_000)), "en", "a"), (10, "é" * 5 + "\x0b" + "日本 語\r\n" + " ".join(words(rng, 70)), "de", "b"), (None, " ".join(base), "en", "a"),
        (8, "one two three", None, "b"), (12, "a " * 120, "en", "c"), (13, " ".join(base[:200]), "en", "c"), (14, " ".join(base[:200] + words(rng, 5)), "en", "c"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make_docs(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return make_docs(spark, [])
