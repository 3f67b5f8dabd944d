"""Stages of the pipeline. Each takes (spark, docs, sf_dir), where docs is a scan of
stored files, and returns the documents it keeps with all their columns.

Rows are told apart by row number, so a null or repeated doc_id is a row like any
other, and columns of any name pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dart_minhash as DM
from . import exact_dedup as ED
from . import factorization as FM
from . import mixing as MX
from . import pieces as PC
from .common import id_text, identified, table


def _kept(docs: DataFrame, judged) -> DataFrame:
    """docs without the rows that ``judged`` doesn't keep. It gets (_row, doc_id, text)
    of the identified rows, and returns _row and kept."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    whole = identified(docs, name)
    rows = id_text(whole, F.col(name).alias("_row"))
    return whole.join(judged(rows).where("NOT kept").select(F.col("_row").alias(name)), name, "left_anti").drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of sf_dir, rejects go."""
    return FM.accepted(docs, FM.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return _kept(docs, ED.exact_rows)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates one document stays."""
    return _kept(docs, DM.near_rows)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents with the target weights of sources, languages and topics."""
    return MX.sample(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their sampled piece ids and the number of these (columns
    piece_ids and n_pieces, with an underscore more where docs has such a name)."""
    names = []
    for name in ("piece_ids", "n_pieces"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    return PC.encode(docs, PC.load(), ids=names[0], count=names[1])
