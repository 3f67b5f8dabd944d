"""Rows keep their numbers when later jobs pack the files into other splits."""

import itertools

import pytest
from pyspark.sql import DataFrameWriter

from tessera.llm import backoff_lm as LM
from tessera.llm import common as C
from tessera.llm import stages
from tessera.llm import substring_dedup as SD

from .conftest import word_text


@pytest.fixture
def shifting(spark, monkeypatch):
    """After every stored table the next scan has another number of splits."""
    turns, write = itertools.cycle((1, 64, 64, 1)), DataFrameWriter.parquet

    def parquet(self, *args, **options):
        write(self, *args, **options)
        spark.conf.set("spark.sql.files.minPartitionNum", next(turns))
    docs = [(i, word_text(5000 + i, 80)) for i in range(40)]
    docs += [(100 + i, docs[i][1] + " more") for i in range(20)] + [(200 + i, docs[i][1] + " ") for i in range(10)]
    docs = C.store(spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id"), "shifting")
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    yield docs
    spark.conf.unset("spark.sql.files.minPartitionNum")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_exact(spark, shifting):
    assert ids(stages.exact(spark, shifting, "")) == [*range(10, 40), *range(100, 120), *range(200, 210)]


def test_near(spark, shifting):
    assert ids(stages.near(spark, shifting, "")) == [*range(40)]


def test_substring(shifting):
    got = {r.doc_id: r.n_removed for r in SD.substring_dedup(shifting).collect()}
    assert got == {i: 80 if i >= 100 else 0 for i in got} and len(got) == 70


def test_backoff(spark, shifting):
    steady = sorted(map(tuple, LM.score(C.store(shifting, "steady").coalesce(1)).collect()))
    spark.conf.set("spark.sql.files.minPartitionNum", 64)
    got = sorted(map(tuple, LM.score(shifting).collect()))
    assert len(got) == 70 and [g[:5] for g in got] == [w[:5] for w in steady]
    assert [g[5:] for g in got] == [pytest.approx(w[5:], rel=1e-9) for w in steady]
