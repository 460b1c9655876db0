"""Rows that every operator must handle: nulls, empty and long texts, repeated rows, columns with the operators' own names."""

import random

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for themselves.
CLASHING = "mark fp key chunk shard slot size words rows unit same tokens epoch block source_ toxic kept kind start n k".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    long = words(rng, 30_000)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, "one two three", "en", "a", 13),
        (4, "one two three", "en", "a", 13),
        (None, "one two three", "en", "b", 13),
        (5, long, "en", "hot", len(long)),
        (6, long, "en", "hot", len(long)),
        (7, "€ 中文 Ünïcode ÀÉ " + words(rng, 50), "de", None, 60),
        (8, "x" * 200_000, "de", "hot", 200_000),
    ]
    rows += [(100 + i, words(rng, 60), "en", "hot", 1) for i in range(30)]
    return rows + [(200 + i, rows[10][1], "en", "hot", 1) for i in range(12)]


@pytest.fixture(scope="session")
def edges(spark):
    docs = spark.createDataFrame(edge_rows(), DOCUMENTS).repartition(4)
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
