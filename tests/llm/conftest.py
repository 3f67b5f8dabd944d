import random

import pytest
from pyspark.sql import types as T

from tessera.llm import common as C

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("_row", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("key", T.StringType())])


def word_text(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def messy_rows():
    long = word_text(1, 30_000)
    edited = long.split(" ")
    edited[100], edited[20_000] = "changed", "also"
    base = word_text(2, 300)
    near = base.split(" ")
    near[150] = "other"
    texts = [None, "", " \t\n", "é", "a b", "ab", " a\tb ", "Ünï cödé ▁ tëxt 🙂   x", long, " ".join(edited), base, base + " ", " ".join(near),
             "same words " * 60, "no\nno\nyes\nno", word_text(3, 80), word_text(4, 4), "\x00odd\x1f \x85 text"]
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 4}", len(t or ""), "x", "y", "z", "k") for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (10, "another text under the same id", None, None, None, None, None, None, None),
             (None, base, None, "src0", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return C.store(spark.createDataFrame(messy_rows(), SCHEMA).repartition(3, "doc_id"), "messy")


@pytest.fixture(scope="session")
def nothing(spark):
    return C.store(spark.createDataFrame([], SCHEMA), "nothing")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
