"""End-to-end topic building (C1, C2, C4/G7) and reload.

    documents → clean → keywords (MMR, thresholded) → keyword vectors → reduce
    → cluster keywords → label clusters → assign topics → topic table
    → collapse similar topics → save → tag with the scenario

The expensive per-document result (keywords) is checkpointed in the shared
checkpoint folder, so later stages and a lost executor never recompute MMR.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster as CL
from ..operators import keywords as K
from ..operators import labels as L
from ..operators import reduce as R
from ..operators import tables as TB
from ..session import cut_lineage
from ..sources import store as ST
from .corpus import Corpus

REDUCERS = ("PCA", "PROJECTION")


@dataclass
class Params:
    reducer: str = "PCA"
    dims: int = 5
    method: str = "HDBSCAN"
    eps: float = 0.2  # of DBSCAN
    min_samples: int = 15  # also the smallest cluster of HDBSCAN
    k: int = 10
    threshold: float = 0.85
    top_n: int = K.TOP_N
    diversity: float = K.DIVERSITY


@dataclass
class Built:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    model: object | None = None  # fitted MLlib model of the clusterer, when it has one

    def __getitem__(self, k: str) -> DataFrame:
        return self.tables[k]

    @property
    def topics(self) -> TB.Topics:
        """The uncollapsed topics."""
        return topics_from(self.tables)


def topics_from(tables: dict[str, DataFrame]) -> TB.Topics:
    return TB.Topics(tables["topics"], tables["topic_doc"], tables["topic_keyword"])


def _check(p: Params) -> None:
    if p.reducer not in REDUCERS:
        raise ValueError(f"Unknown reduction method: {p.reducer}")
    CL.check_method(p.method)


def keyword_clusters(reduced: DataFrame, p: Params):
    """((keyword, cluster), fitted model or None) with the chosen method."""
    if p.method == "KMeans":
        return CL.kmeans_fit(reduced, "keyword", "r", k=p.k)
    if p.method == "HDBSCAN":
        return CL.density(reduced, "keyword", "r", min_size=p.min_samples), None
    return CL.dbscan(reduced, "keyword", "r", eps=p.eps, min_samples=p.min_samples, metric="cosine"), None


def topic_modelling(corpus: Corpus, p: Params, replies: DataFrame | None = None) -> Built:
    """The uncollapsed topic table and everything needed to predict."""
    _check(p)
    kw = cut_lineage(corpus.keywords(top_n=p.top_n, diversity=p.diversity))
    vocab = cut_lineage(K.vocabulary(kw))
    phrases = vocab.select(F.col("keyword"), F.col("keyword").alias("phrase"))
    kvec = cut_lineage(corpus.phrase_vectors(phrases, "keyword"))
    if p.reducer == "PCA":
        reduced, matrix = R.reduce_pca(kvec, "keyword", "v", p.dims)
    else:
        matrix = R.projection_matrix(kvec.sparkSession, k=p.dims)
        reduced = R.reduce_projection(kvec, "keyword", "v", p.dims)
    reduced = cut_lineage(reduced)
    kc, model = keyword_clusters(reduced, p)
    kc = cut_lineage(kc)
    labels = L.class_tfidf_labels(kc)
    if replies is not None:
        labels = L.parse_replies(replies, labels)
    labels = cut_lineage(labels)
    kt = L.keyword_topics(kc, labels)
    dtp = TB.assign_topics(kw, kt)
    topics = TB.topics_of(cut_lineage(dtp), cut_lineage(TB.topic_keywords(vocab, kt)))
    tvec = corpus.phrase_vectors(L.label_phrases(labels), "topic")
    # what prediction looks up: HDBSCAN's noise keywords keep what is nearest to them out of the clusters
    core = reduced.join(kc, "keyword").where((F.col("cluster") != L.NOISE) | F.lit(p.method == "HDBSCAN"))
    return Built({
        "doc_keywords": kw, "vocabulary": vocab, "keyword_vectors": kvec, "reduced": reduced,
        "keyword_cluster": kc, "cluster_topic": L.label_table(labels), "keyword_topic": kt,
        "topics": topics.counts, "topic_doc": topics.documents, "topic_keyword": topics.keywords, "topic_vectors": cut_lineage(tvec), "reducer": matrix,
        "cluster_model": core, "term_stats": corpus.stats,
        "token_vectors": corpus.token_vectors(),
    }, model)


def collapse_built(b: Built, threshold: float) -> tuple[TB.Topics, DataFrame]:
    """G6 on a built scenario."""
    return TB.collapse(b.topics, b["topic_vectors"], threshold)


def tagged(topics: TB.Topics, scenario: str) -> DataFrame:
    """P11 in the form of an export: list cells and the scenario's name."""
    return topics.listed().withColumn("scenario", F.lit(scenario))


def fingerprint(corpus: Corpus, p: Params, replies: DataFrame | None = None) -> str:
    """Of all parameters but the collapse threshold, which a reload can change, of the
    documents and of the label replies, in one pass over them."""
    digest = lambda df: tuple(df.select(F.xxhash64(*df.columns).alias("h"))
                              .agg(F.count("*"), F.bit_xor("h"), F.sum(F.shiftright("h", 20))).first())
    what = [{k: v for k, v in asdict(p).items() if k != "threshold"}, corpus.stop_words, digest(corpus.docs), digest(replies) if replies is not None else None]
    return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()


def build_topics(corpus: Corpus, scenario: str, p: Params | None = None, root: str | None = None,
                 replies: DataFrame | None = None, save: bool = True, redo: bool = False) -> tuple[TB.Topics, Built]:
    """Build, collapse, save. Returns (collapsed topics, parts).
    A saved scenario of that name is reused if it was built from the same documents with
    the same parameters, collapsed anew if its threshold differs, unless ``redo`` asks
    for a new build. The parts hold the same tables either way."""
    p = p or Params()
    spark = corpus.docs.sparkSession
    root = root or ST.default_root(spark)
    mark = fingerprint(corpus, p, replies) if save else None
    if save and not redo and ST.manifest(spark, root, scenario)[1] == mark and not ST.missing(spark, root, scenario, SAVED):
        topics = reload_topics(spark, root, scenario, p.threshold)
        return topics, Built(ST.load(spark, root, scenario, SAVED))
    b = topic_modelling(corpus, p, replies)
    merged, mapping = collapse_built(b, p.threshold)
    b.tables["mapping"] = cut_lineage(mapping)
    merged = TB.merge_topics(b["topic_doc"], b["topic_keyword"], b["mapping"])
    b.tables["params"] = spark.createDataFrame(
        [(float(p.threshold), p.reducer, p.method, float(p.eps), int(corpus.n_docs), json.dumps(corpus.stop_words, sort_keys=True))],
        "threshold DOUBLE, reducer STRING, method STRING, eps DOUBLE, n_docs BIGINT, stop_words STRING")
    if save:
        ST.save({n: b[n] for n in SAVED}, root, scenario, mark, b.model)
    return merged, b


NEEDED = ("topics", "topic_doc", "topic_keyword", "topic_vectors", "mapping", "params")  # what reload and re-collapse read
SAVED = (*ST.REQUIRED, "doc_keywords", "vocabulary")


def reload_topics(spark, root: str, scenario: str, threshold: float | None = None) -> TB.Topics:
    """S11 (+B5): read the saved uncollapsed topics and map; when ``threshold``
    differs from the saved one, re-collapse (G7) instead."""
    t = ST.load(spark, root, scenario, NEEDED)
    saved = t["params"].first()["threshold"]
    if threshold is not None and float(threshold) != float(saved):
        return recollapse(spark, root, scenario, threshold)
    mapping = ST.load_mapping(spark, root, scenario, t["topics"])
    return TB.merge_topics(t["topic_doc"], t["topic_keyword"], mapping)


def recollapse(spark, root: str, scenario: str, threshold: float) -> TB.Topics:
    """Collapse the saved uncollapsed topics with a new threshold and
    save the new map and threshold with the scenario, both at once."""
    t = ST.load(spark, root, scenario, NEEDED)
    merged, mapping = TB.collapse(topics_from(t), t["topic_vectors"], threshold)
    mapping = cut_lineage(mapping)
    params = cut_lineage(t["params"].withColumn("threshold", F.lit(float(threshold))))
    ST.save({"mapping": mapping, "params": params}, root, scenario, keep=True)
    return TB.merge_topics(t["topic_doc"], t["topic_keyword"], mapping)
