"""Topic tables: assignment, aggregation, merging and collapsing
(J1-J11, A3-A7, A9, A10, K6, G5-G8).

A topic's documents and keywords are rows of two tables, (topic, doc_id) and
(topic, keyword), on every path from build to prediction: a topic that a third of all
documents have is many rows and no cell. Counts are distinct rows, then sums with
partial aggregation. ``Topics.listed`` makes the table with list cells, for export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import graph as G

COLLAPSE_THRESHOLD = 0.85
PREDICT_GATE = 0.4


def assign_topics(doc_keywords: DataFrame, kw_topics: DataFrame) -> DataFrame:
    """G8 = J1 + A7: distinct (doc_id, topic) from keyword membership."""
    return doc_keywords.select("doc_id", "keyword").join(kw_topics, "keyword").select("doc_id", "topic").distinct()


def topic_keywords(vocab: DataFrame, kw_topics: DataFrame) -> DataFrame:
    """(topic, keyword) for vocabulary keywords that have a topic."""
    return vocab.select("keyword").join(kw_topics, "keyword").select("topic", "keyword").distinct()


def noise_keywords(vocab: DataFrame, kw_topics: DataFrame) -> DataFrame:
    """Vocabulary keywords without a topic."""
    return vocab.select("keyword").join(kw_topics, "keyword", "left_anti")


def covered_docs(docs: DataFrame, doc_topics: DataFrame) -> DataFrame:
    """Documents having at least one topic."""
    return docs.select("doc_id").join(doc_topics, "doc_id", "left_semi")


@dataclass
class Topics:
    """counts (topic, n_documents), documents (topic, doc_id), keywords (topic, keyword);
    distinct rows. Topics without documents are absent (as in the reference)."""
    counts: DataFrame
    documents: DataFrame
    keywords: DataFrame

    def listed(self) -> DataFrame:
        """topic, n_documents, documents (sorted), topic_keywords (sorted, [] when none): the
        form of an export, with a cell as large as its topic."""
        docs = self.documents.groupBy("topic").agg(F.array_sort(F.collect_list("doc_id")).alias("documents"))
        kws = self.keywords.groupBy("topic").agg(F.array_sort(F.collect_list("keyword")).alias("topic_keywords"))
        return (self.counts.join(docs, "topic").join(kws, "topic", "left")
                .select("topic", "n_documents", "documents", F.coalesce("topic_keywords", F.array().cast("array<string>")).alias("topic_keywords")))


def topics_of(doc_topics: DataFrame, topic_kws: DataFrame) -> Topics:
    """A5 + J3 in long form, from rows that may repeat. The distinct rows and the counts are
    stored, as every use of the topics reads them several times."""
    docs = stored(doc_topics.select("topic", "doc_id").where(F.col("topic").isNotNull() & F.col("doc_id").isNotNull()).distinct(), "topic_doc")
    counts = stored(docs.groupBy("topic").agg(F.count(F.lit(1)).alias("n_documents")), "topics")
    return Topics(counts, docs, topic_kws.select("topic", "keyword").distinct().join(counts.select("topic"), "topic", "left_semi"))


def topic_table(doc_topics: DataFrame, topic_kws: DataFrame) -> DataFrame:
    """A5 + J3 as a table with list cells."""
    return topics_of(doc_topics, topic_kws).listed()


def identity_mapping(topics: DataFrame) -> DataFrame:
    """(topic, parent=topic) over distinct topics."""
    return topics.select("topic").distinct().select("topic", F.col("topic").alias("parent"))


def apply_mapping(long_df: DataFrame, mapping: DataFrame, col: str = "topic") -> DataFrame:
    """Replace ``col`` by its parent; unmapped values map to themselves."""
    m = mapping.select(F.col("topic").alias("_t"), F.col("parent").alias("_p"))
    return (long_df.join(m, long_df[col] == m["_t"], "left")
            .withColumn(col, F.coalesce(F.col("_p"), F.col(col))).drop("_t", "_p"))


def merge_topics(doc_topics: DataFrame, topic_kws: DataFrame, mapping: DataFrame) -> Topics:
    """Rows with equal (mapped) topic merged; documents and keywords de-duplicated."""
    return topics_of(apply_mapping(doc_topics, mapping), apply_mapping(topic_kws, mapping))


def similar_topic_mapping(topics: DataFrame, topic_vecs: DataFrame, threshold: float = COLLAPSE_THRESHOLD,
                          grid_dims: int = 3) -> DataFrame:
    """G5 on topics: (topic, parent). Popularity order is (n_documents desc,
    topic asc); pairs come from the exact eps-join (J7). A topic without a vector
    (no known token in its label) is its own parent."""
    nodes = stored(topics.select("topic", "n_documents").join(topic_vecs, "topic"), "topic_nodes")
    pairs = G.cosine_pairs(nodes.select(F.col("topic"), "v"), "topic", "v", threshold, grid_dims).select("a", "b")
    order = F.struct((-F.col("n_documents")).alias("nd"), F.col("topic").alias("t"))
    groups = G.leader_groups(nodes.select(F.col("topic").alias("id"), order.alias("rank")), pairs)
    found = groups.select(F.col("id").alias("topic"), F.col("leader").alias("parent"))
    return topics.select("topic").join(found, "topic", "left").select("topic", F.coalesce("parent", "topic").alias("parent"))


def collapse(topics: Topics, topic_vecs: DataFrame, threshold: float = COLLAPSE_THRESHOLD) -> tuple[Topics, DataFrame]:
    """(merged topics, mapping). threshold ≥ 1 → identity."""
    if threshold >= 1.0:
        mapping = identity_mapping(topics.counts)
    else:
        mapping = similar_topic_mapping(topics.counts, topic_vecs, threshold)
    return merge_topics(topics.documents, topics.keywords, mapping), mapping


def with_keywords(rows: DataFrame, keywords: DataFrame) -> DataFrame:
    """Rows with a topic, each with the list of its topic's keywords, for export."""
    kws = keywords.join(rows.select("topic").distinct(), "topic", "left_semi").groupBy("topic").agg(F.array_sort(F.collect_set("keyword")).alias("topic_keywords"))
    return rows.join(kws, "topic", "left").withColumn("topic_keywords", F.coalesce("topic_keywords", F.array().cast("array<string>")))
