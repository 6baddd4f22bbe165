"""Small tables with everything that may go wrong in them."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside, and one with a dot
    T.StructField("t", T.StringType()), T.StructField("row", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("size", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("_gone", T.LongType()), T.StructField("a.b", T.LongType()),
])


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    return " ".join(words(seed, n))


def messy_rows() -> list[tuple]:
    base = words(1, 160)
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", "en", None), (4, "one two three", "en", "a"), (5, "One  TWO\nthree", "de", "b"),
        (6, prose(6, 30_000), "en", "a"), (7, "x" * 200_000, "en", "a"), (8, "Été 日本 <|endoftext|> it's 'll\n\n b  c", "fr", "b"),
        (9, " ".join(base), "en", "a"), (10, " ".join(base), "en", "b"), (11, " ".join(base).upper(), "en", "b"),
        (12, "a b c " * 60, "en", "a"), (13, "same line here\n" * 40, "en", "a"), (14, "#### $$ %% && | < > * " * 20, "en", "a"),
        (15, "Released under the MIT License. Some Apache  license, mit-license MIT", "en", "a"),
    ]
    rng = random.Random(5)
    for i in range(20, 60):  # near copies, more and less edited
        edited = list(base)
        for _ in range(rng.randint(0, 6)):
            edited[rng.randrange(len(edited))] = f"w{i}{rng.randint(0, 99)}"
        rows.append((i, " ".join(edited), "en", "a" if i % 3 else "c"))
    for i in range(60, 70):  # a passage that many share
        rows.append((i, prose(i, 80) + " " + " ".join(base[:70]) + " " + prose(1000 + i, 40), "es", "c"))
    rows += [(4, "one two three", "en", "a"), (9, " ".join(base), "en", "a"), (None, "one two three", "en", "a"), (None, None, None, None)]
    return rows


def frame(spark, rows):
    full = [(i, t, g, s, None if t is None else len(t), "clash", 1, 2, "clash", "clash", 3, 4) for i, t, g, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def messy(spark):
    return frame(spark, messy_rows()).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
