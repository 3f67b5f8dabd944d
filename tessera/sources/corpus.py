"""Reading documents and ready-made vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

# Fixed value: a character that isn't white space in Unicode's sense (with the
# separators 1C-1F); a document without one is blank. Java and RE2 read it alike.
BLANK_CLASS = (r"[^\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def read_corpus(spark: SparkSession, sf_dir: str, name: str = "documents", id_col: str = "doc_id",
                text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """Id and text of each record (and its language, if asked for); the Parquet
    scan reads only these columns."""
    return table(spark, sf_dir, name).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                                             *([F.col(lang_col).alias("lang")] if lang_col else []))


def nonblank(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """S3: drop null or whitespace-only documents (a pushed-down data filter)."""
    return docs.where(F.col(text_col).rlike(BLANK_CLASS))


def sample(docs: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """Deterministic sample of n documents — smallest md5(id), ties by id.
    Plans as a per-partition top-n merged once (TakeOrderedAndProject): memory
    is bounded by n, not by the table."""
    return docs.orderBy(F.md5(F.col(id_col).cast("string")), F.col(id_col)).limit(int(n))


def attach_vectors(items: DataFrame, vectors: DataFrame, key: str, vec_key: str = "vec_id",
                   vec_col: str = "embedding") -> DataFrame:
    """Items matched to user-supplied vectors by key (inner equi-join);
    vectors arrive as ARRAY<DOUBLE> named ``v``."""
    vec = vectors.select(F.col(vec_key).alias(key), F.col(vec_col).cast("array<double>").alias("v"))
    return items.join(vec, key)


def read_conversations(spark: SparkSession, sf_dir: str, name: str = "conversations") -> DataFrame:
    """A conversation as one document: its turns' text joined by newlines in
    turn order. One group per conversation, bounded by its own turns."""
    turns = table(spark, sf_dir, name)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return (turns.groupBy("conv_id")
            .agg(F.concat_ws("\n", F.transform(ordered, lambda x: x["text"])).alias("text"))
            .select(F.col("conv_id").alias("doc_id"), "text"))
