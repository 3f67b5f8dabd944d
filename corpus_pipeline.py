"""The training-data pipeline: stages over the documents table, each written as
Parquet and read again before the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages as S
from tessera.llm.common import store, table

STAGES = [
    ("quality classifier", S.quality),
    ("exact dedup", S.exact),
    ("near dedup", S.near),
    ("mixing", S.mixing),
    ("pieces", S.pieces),
]

ORACLE_SQL = None  # a trained classifier and hashed signatures have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
