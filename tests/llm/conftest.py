"""Awkward tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing names."""

import random

import pytest
from llm_helpers import CLASHES, SCHEMA, near, sentence

from lexigraf.llm.common import prepare


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, ties, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(4)
    passage = sentence(rng, 60)
    out = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, "", None, "b", 0), (3, " \t\n", "en", "a", 3), (4, "one two", "en", "a", 7), (None, "no id here", "en", "b", 10)]
    for i in range(5, 45):
        out.append((i, sentence(rng, rng.randrange(1, 90)), "en", rng.choice("abc"), 1))
    for i in range(45, 60):
        out.append((i, out[10 + i % 5][1], "en", "a", 1))  # copies
    base = sentence(rng, 120)
    for i in range(60, 75):
        out.append((i, near(rng, base, rng.randrange(0, 5)), "en", "a", 1))  # near copies
    for i in range(75, 85):
        out.append((i, sentence(rng, 10) + " " + passage + " " + sentence(rng, 12), "en", "c", 1))
    out.append((85, sentence(rng, 20000), "en", "b", 1))
    out.append((86, "é" * 150 + passage[:150] + "é" * 150, "fr", None, 1))
    return out + [out[20], out[20]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    prepare(spark)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same rows with columns named as the operators name theirs."""
    frame = docs
    for c in CLASHES:
        frame = frame.withColumn(c, docs["n_chars"])
    return frame
