from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, shard string, rate double, copy string, n_copies int, size string, __hash int, __chunk string, __maybe boolean, row int, component long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with those that operators use."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    long_text = " ".join(rng.choice(words) for _ in range(40_000))
    line = "The same LINE of boilerplate, long enough to count as one. "
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, " \t\n ", "en", "a"), (4, long_text, "en", "b"), (5, long_text, "en", "b"),
        (6, "one two", "en", "b"), (7, "one  two", "en", "b"), (8, "x" * 1200, "en", "b"), (9, "é" * 500 + " " + "Z", "fr", "c"), (10, long_text + " tail", "en", "b"),
        (None, "no id here", "en", "a"), (None, "no id here", "en", "a"), (11, "repeated row", "en", "b"), (11, "repeated row", "en", "b"),
        *[(20 + k, f"{line}\nunique line number {k} which is also long enough to be counted\n  {line.upper()}\t", "en", "b") for k in range(7)],
    ]
    rows = [(*r, len(r[1] or ""), 99, 7, "clash", 0.25, "own", 3, "big", 5, "c", False, 1, -1) for r in rows]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
