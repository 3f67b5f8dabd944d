"""Cluster labels.

Default label: the cluster's 5 most characteristic keyword tokens by
class-based tf-idf, ``tf(t, c) · ln(1 + A / cf(t))`` with A the mean number of
token occurrences per cluster, ties by token, joined by a space. Clusters that
end with equal labels are one topic. Label requests for an external labelling
job and the parsing of its replies are table operations as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NOISE = -1
# Fixed values (reference defaults and the failure text for unusable replies).
TERMS_PER_LABEL = 5
KEYWORDS_PER_REQUEST = 50
OUTLIER_LABEL = "Outlier"
FAILED_LABEL = "Topic extraction failed"

# One request row per cluster; the cluster's keywords are appended.
REQUEST_TEXT = (
    "The list below holds the most frequent keywords of one cluster of documents, in order of document count. "
    "The label you give becomes the key that documents are joined on, so write it in the keywords' own language, "
    "with words from the list where possible and without quotation marks. "
    "Reply with one JSON object whose field \"topic\" holds the label.\n"
    "Keywords: "
)


def clustered(keyword_clusters: DataFrame) -> DataFrame:
    """P10: drop the noise cluster."""
    return keyword_clusters.where(F.col("cluster") != NOISE)


def class_tfidf_labels(keyword_clusters: DataFrame, n_terms: int = TERMS_PER_LABEL) -> DataFrame:
    """(cluster, topic) for every non-noise cluster."""
    kc = clustered(keyword_clusters)
    toks = (kc.select("cluster", F.explode_outer(F.split("keyword", " ")).alias("token"))
            .where(F.col("token").isNotNull() & (F.col("token") != "")))
    tf = toks.groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("tf"))
    cf = tf.groupBy("token").agg(F.sum("tf").alias("cf"))
    tot = tf.agg(F.sum("tf").alias("s"), F.countDistinct("cluster").alias("c")).first()
    if not tot or not tot["c"]:
        return keyword_clusters.sparkSession.createDataFrame([], "cluster INT, topic STRING")
    avg = float(tot["s"]) / float(tot["c"])
    w = tf.join(cf, "token").withColumn("w", F.col("tf") * F.log(F.lit(1.0) + F.lit(avg) / F.col("cf")))
    rk = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("w"), F.asc("token")))
    top = w.withColumn("rk", rk).where(F.col("rk") <= int(n_terms))
    return (top.groupBy("cluster")
            .agg(F.array_sort(F.collect_list(F.struct("rk", "token"))).alias("t"))
            .select(F.col("cluster").cast("int"), F.concat_ws(" ", F.transform("t", lambda x: x["token"])).alias("topic")))


def keystrings(keyword_clusters: DataFrame, vocab: DataFrame, limit: int = KEYWORDS_PER_REQUEST) -> DataFrame:
    """K5: (cluster, keystring) — the first ``limit`` keywords of each cluster
    by document count (desc) then keyword, joined by ','."""
    kc = clustered(keyword_clusters).join(vocab.select("keyword", "n_documents"), "keyword", "left")
    rk = F.row_number().over(Window.partitionBy("cluster").orderBy(
        F.desc(F.coalesce(F.col("n_documents"), F.lit(0))), F.asc("keyword")))
    top = kc.withColumn("rk", rk).where(F.col("rk") <= int(limit))
    return (top.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rk", "keyword"))).alias("k"))
            .select(F.col("cluster").cast("int"), F.concat_ws(",", F.transform("k", lambda x: x["keyword"])).alias("keystring")))


def label_requests(keys: DataFrame) -> DataFrame:
    """(cluster, request) — the text to send to a labelling job."""
    return keys.select("cluster", F.concat(F.lit(REQUEST_TEXT), F.col("keystring")).alias("request"))


def parse_replies(replies: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(cluster, topic) from (cluster, reply): the JSON field ``topic`` of
    the trimmed reply. A missing or unusable reply, also one with an empty topic,
    gives the cluster's default label from ``fallback`` (cluster, topic); clusters of
    either table are in the result. Without a default, an unusable reply gets the
    failure text. Of several usable replies of a
    cluster the first in order of text counts."""
    topic = F.trim(F.get_json_object(F.trim("reply"), "$.topic"))
    parsed = replies.select("cluster", F.when(topic != "", topic).alias("parsed")).groupBy("cluster").agg(F.min("parsed").alias("parsed"))
    if fallback is None:
        return parsed.select("cluster", F.coalesce("parsed", F.lit(FAILED_LABEL)).alias("topic"))
    return (fallback.select("cluster", F.col("topic").alias("fb")).join(parsed, "cluster", "full")
            .select("cluster", F.coalesce("parsed", "fb", F.lit(FAILED_LABEL)).alias("topic")))


def label_table(cluster_topics: DataFrame) -> DataFrame:
    """The label table with the row of the noise cluster."""
    noise = cluster_topics.sparkSession.range(1).select(F.lit(NOISE).cast("int").alias("cluster"), F.lit(OUTLIER_LABEL).alias("topic"))
    return cluster_topics.select("cluster", "topic").unionByName(noise)


def label_phrases(cluster_topics: DataFrame) -> DataFrame:
    """(topic, phrase): labels cleaned like document text, so that a label written
    with capitals, accents or punctuation finds its tokens."""
    words = T.drop_stop_words(T.clean_tokens(F.col("topic")))
    return cluster_topics.select("topic").distinct().select("topic", F.concat_ws(" ", words).alias("phrase"))


def keyword_topics(keyword_clusters: DataFrame, cluster_topics: DataFrame) -> DataFrame:
    """(keyword, topic) for clustered keywords (noise keywords have no topic)."""
    return clustered(keyword_clusters).join(cluster_topics, "cluster").select("keyword", "topic")
