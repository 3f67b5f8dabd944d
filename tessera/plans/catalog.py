"""Registered queries: name → (Spark builder, DuckDB oracle SQL or None).

Every builder takes (spark, sf_dir) and reads the given tables; every output
column is aliased identically on both sides. Doubles are rounded at the end and
arrays are emitted as joined strings so results hash the same in both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle as O
from ..functions import text as T
from ..functions.stopwords import stop_words_by_language
from ..functions import vectors as VF
from ..operators import cluster as CL
from ..operators import graph as G
from ..operators import keywords as K
from ..operators import labels as L
from ..operators import tables as TB
from ..operators import reduce as R
from ..operators import vectors as V
from ..sources import corpus as S
from ..session import cut_lineage, table
from .corpus import Corpus

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(S.read_corpus(spark, sf_dir))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- sources, text

@register("corpus_scan", "SELECT doc_id, text FROM documents")
def q_corpus_scan(spark, sf):
    return S.read_corpus(spark, sf)


@register("nonblank_docs",
          "SELECT doc_id, text FROM documents WHERE regexp_matches(text, '" + S.BLANK_CLASS + "')")
def q_nonblank(spark, sf):
    return S.nonblank(S.read_corpus(spark, sf))


@register("sample_docs",
          "SELECT doc_id, text FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def q_sample(spark, sf):
    return S.sample(S.read_corpus(spark, sf), 100)


@register("strip_tags",
          "SELECT page_id, md5(regexp_replace(html, '<([^>]+)>', '', 'g')) AS text_md5, "
          "length(regexp_replace(html, '<([^>]+)>', '', 'g'))::BIGINT AS n_chars FROM pages")
def q_strip_tags(spark, sf):
    s = T.strip_tags(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.md5(s).alias("text_md5"),
                                            F.length(s).cast("bigint").alias("n_chars"))


@register("deaccent",
          "SELECT doc_id, md5(strip_accents(lower(text))) AS text_md5, "
          "length(strip_accents(lower(text)))::BIGINT AS n_chars FROM documents")
def q_deaccent(spark, sf):
    s = T.deaccent(F.lower(F.col("text")))
    return S.read_corpus(spark, sf).select("doc_id", F.md5(s).alias("text_md5"),
                                           F.length(s).cast("bigint").alias("n_chars"))


@register("clean_tokens",
          O.with_(O.corpus_ctes()) + """
SELECT doc_id, len(tokens)::BIGINT AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM tok""")
def q_clean_tokens(spark, sf):
    p = corpus(spark, sf).prepared
    return p.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.md5(F.concat_ws(" ", "tokens")).alias("tokens_md5"))


@register("clean_text",
          O.with_(O.corpus_ctes()) + "\nSELECT doc_id, array_to_string(tokens, ' ') AS clean_text FROM tok")
def q_clean_text(spark, sf):
    p = corpus(spark, sf).prepared
    return p.select("doc_id", T.clean_text(F.col("tokens")).alias("clean_text"))


@register("stopword_filter",
          O.with_(O.corpus_ctes()) + """
SELECT doc_id, len(content)::BIGINT AS n_content, md5(array_to_string(content, ' ')) AS content_md5 FROM content""")
def q_stopword_filter(spark, sf):
    p = corpus(spark, sf).prepared
    return p.select("doc_id", F.size("content").cast("bigint").alias("n_content"),
                    F.md5(F.concat_ws(" ", "content")).alias("content_md5"))


LANGUAGES = ("de", "en", "es", "fr")


def language_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The documents with the stop words of each one's language."""
    return Corpus(S.read_corpus(spark, sf_dir, lang_col="lang"), stop_words=stop_words_by_language(LANGUAGES), lang_col="lang")


@register("stopwords_by_language",
          O.with_(O.language_ctes(LANGUAGES)) + """
SELECT doc_id, len(content)::BIGINT AS n_content, md5(array_to_string(content, ' ')) AS content_md5 FROM content""")
def q_stopwords_by_language(spark, sf):
    p = language_corpus(spark, sf).prepared
    return p.select("doc_id", F.size("content").cast("bigint").alias("n_content"),
                    F.md5(F.concat_ws(" ", "content")).alias("content_md5"))


@register("keywords_by_language",
          O.with_(O.language_ctes(LANGUAGES), O.candidate_ctes(), O.mmr_ctes(), O.threshold_cte("mmr", "kw")) + "\nSELECT * FROM kw")
def q_keywords_by_language(spark, sf):
    return language_corpus(spark, sf).keywords()


@register("ngram_candidates",
          O.with_(O.corpus_ctes(), O.candidate_ctes()) + "\nSELECT doc_id, keyword FROM cm")
def q_ngram_candidates(spark, sf):
    p = corpus(spark, sf).prepared
    g = p.select("doc_id", F.explode_outer(F.array_distinct(T.ngrams(F.col("content")))).alias("keyword"))
    return g.where(F.col("keyword").isNotNull())


# ---------------------------------------------------------------- terms, keywords

@register("term_stats",
          O.with_(O.corpus_ctes()) + "\nSELECT token, df::BIGINT AS df, cf::BIGINT AS cf, round(idf, 9) AS idf FROM ts")
def q_term_stats(spark, sf):
    st = corpus(spark, sf).stats
    return st.select("token", F.col("df").cast("bigint").alias("df"), F.col("cf").cast("bigint").alias("cf"),
                     F.round("idf", 9).alias("idf"))


@register("keyword_relevance",
          O.with_(O.corpus_ctes(), O.candidate_ctes()) + "\nSELECT doc_id, keyword, round(rel, 6) AS score FROM cand")
def q_keyword_relevance(spark, sf):
    return K.relevance_long(corpus(spark, sf).candidates, 6)


@register("top_keywords", O.with_(O.keywords_sql(use_mmr=False, thresholded=False)) + "\nSELECT * FROM kw")
def q_top_keywords(spark, sf):
    return corpus(spark, sf).keywords(use_mmr=False, thresholded=False)


@register("thresholded_keywords", O.with_(O.keywords_sql(use_mmr=False, thresholded=True)) + "\nSELECT * FROM kw")
def q_thresholded(spark, sf):
    return corpus(spark, sf).keywords(use_mmr=False, thresholded=True)


@register("mmr_keywords", O.with_(O.keywords_sql(use_mmr=True, thresholded=False)) + "\nSELECT * FROM kw")
def q_mmr(spark, sf):
    return corpus(spark, sf).keywords(use_mmr=True, thresholded=False)


@register("doc_keywords", O.with_(O.keywords_sql()) + "\nSELECT * FROM kw")
def q_doc_keywords(spark, sf):
    return corpus(spark, sf).keywords()


@register("conversation_keywords",
          O.with_(",\nconv AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)",
                  "," + O.keywords_sql(source="conv", id_col="conv_id")) + "\nSELECT * FROM kw")
def q_conversation_keywords(spark, sf):
    return Corpus(S.read_conversations(spark, sf)).keywords()


@register("keyword_vocabulary",
          O.with_(O.keywords_sql()) + "\nSELECT keyword, count(DISTINCT doc_id)::BIGINT AS n_documents FROM kw GROUP BY keyword")
def q_vocabulary(spark, sf):
    return K.vocabulary(corpus(spark, sf).keywords()).withColumn("n_documents", F.col("n_documents").cast("bigint"))


@register("doc_keyword_lists",
          O.with_(O.keywords_sql()) + "\nSELECT doc_id, string_agg(keyword, '|' ORDER BY rank) AS keywords FROM kw GROUP BY doc_id")
def q_keyword_lists(spark, sf):
    lists = K.keyword_lists(corpus(spark, sf).keywords())
    return lists.select("doc_id", F.concat_ws("|", "keywords").alias("keywords"))


# ---------------------------------------------------------------- vectors

@register("token_vectors",
          O.with_(O.corpus_ctes(), O.token_vector_cte()) +
          "\nSELECT token, array_to_string(tv, ',') AS tv FROM tvec")
def q_token_vectors(spark, sf):
    tv = corpus(spark, sf).token_vectors()
    return tv.select("token", F.concat_ws(",", F.transform("tv", lambda x: x.cast("string"))).alias("tv"))


def _keyword_phrases(c: Corpus) -> DataFrame:
    return c.keywords().select(F.col("keyword").alias("phrase")).distinct().withColumn("keyword", F.col("phrase"))


@register("keyword_vectors",
          O.with_(O.keywords_sql(), ",\nkwv AS (SELECT DISTINCT keyword FROM kw)",
                  O.token_vector_cte(), O.phrase_vector_ctes("kwv", "keyword", "keyword", "kvec")) +
          f"\nSELECT keyword, {O.vec_text('v')} AS v FROM kvec")
def q_keyword_vectors(spark, sf):
    c = corpus(spark, sf)
    kv = c.phrase_vectors(cut_lineage(_keyword_phrases(c)), "keyword")
    return kv.select("keyword", V.vector_text(F.col("v")).alias("v"))


@register("doc_vectors",
          O.with_(O.corpus_ctes(), O.token_vector_cte(), O.doc_vector_ctes()) +
          f"\nSELECT doc_id, {O.vec_text('v')} AS v FROM dvec")
def q_doc_vectors(spark, sf):
    dv = corpus(spark, sf).doc_vectors()
    return dv.select("doc_id", V.vector_text(F.col("v")).alias("v"))


@register("cosine_pairs",
          f"SELECT a.vec_id, b.vec_id AS next_id, round({O.cosine_sql('CAST(a.embedding AS DOUBLE[])', 'CAST(b.embedding AS DOUBLE[])')}, 6) AS cosine "
          "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def q_cosine_pairs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("v").alias("w"))
    return e.join(b, "vec_id").select("vec_id", "next_id", F.round(VF.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@register("l2_normalize",
          f"SELECT vec_id, {O.vec_text('list_transform(embedding, lambda x: x / sqrt(list_reduce(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE), lambda p, q: p + q)))')} AS v FROM embeddings")
def q_l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", V.vector_text(VF.l2_normalize(F.col("v"))).alias("v"))


@register("attach_vectors",
          "SELECT b.item_id, len(e.embedding)::BIGINT AS dims, e.label FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id")
def q_attach_vectors(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id")
    vecs = table(spark, sf, "embeddings")
    out = S.attach_vectors(items, vecs, "item_id").join(
        vecs.select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    return out.select("item_id", F.size("v").cast("bigint").alias("dims"), "label")


# ---------------------------------------------------------------- pairs, graphs, clusters

SIM_T = 0.4


def _emb(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


_E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _pairs_sql(cond: str) -> str:
    return (f"pairs AS (SELECT a.id AS a, b.id AS b, {O.cosine_sql('a.v', 'b.v')} AS cosine "
            f"FROM e a JOIN e b ON a.id < b.id WHERE {cond.format(cos=O.cosine_sql('a.v', 'b.v'))})")


@register("similar_topic_pairs",
          f"WITH {_E}, {_pairs_sql('{cos} >= ' + repr(SIM_T))} "
          "SELECT a, b, round(cosine, 6) AS cosine FROM pairs")
def q_similar_pairs(spark, sf):
    p = G.cosine_pairs(_emb(spark, sf), "vec_id", "v", SIM_T)
    return p.select("a", "b", F.round("cosine", 6).alias("cosine"))


@register("similar_components",
          f"WITH RECURSIVE {_E}, {_pairs_sql('{cos} >= ' + repr(SIM_T))}, "
          "und AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), "
          "reach(src, dst) AS (SELECT id, id FROM e UNION SELECT r.src, u.b FROM reach r JOIN und u ON u.a = r.dst) "
          "SELECT src AS id, min(dst) AS comp FROM reach GROUP BY src")
def q_similar_components(spark, sf):
    e = _emb(spark, sf)
    pairs = G.cosine_pairs(e, "vec_id", "v", SIM_T).select("a", "b")
    return G.connected_components(e.select(F.col("vec_id").alias("id")), pairs)


@register("similar_topic_groups",
          f"WITH RECURSIVE {_E}, {_pairs_sql('{cos} >= ' + repr(SIM_T))}, "
          "nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS rk FROM e), "
          "nb AS (SELECT n.rk, n.id, list(p.a) FILTER (WHERE p.a IS NOT NULL) AS earlier "
          "       FROM nodes n LEFT JOIN pairs p ON p.b = n.id GROUP BY n.rk, n.id), "
          "g(rk, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL "
          "  SELECT g.rk + 1, CASE WHEN len(list_filter(coalesce(nb.earlier, []::BIGINT[]), lambda x: list_contains(g.leaders, x))) > 0 "
          "                   THEN g.leaders ELSE list_append(g.leaders, nb.id) END "
          "  FROM g JOIN nb ON nb.rk = g.rk + 1), "
          "fin AS (SELECT leaders FROM g ORDER BY rk DESC LIMIT 1), "
          "lead AS (SELECT unnest(leaders) AS id FROM fin) "
          "SELECT id, id AS leader FROM lead UNION ALL "
          "SELECT p.b AS id, min(p.a) AS leader FROM pairs p WHERE p.a IN (SELECT id FROM lead) "
          "AND p.b NOT IN (SELECT id FROM lead) GROUP BY p.b")
def q_similar_groups(spark, sf):
    e = _emb(spark, sf)
    pairs = G.cosine_pairs(e, "vec_id", "v", SIM_T).select("a", "b")
    return G.leader_groups(e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("rank")), pairs)


def dbscan_sql(eps: float, min_samples: int = 15) -> str:
    return (f"WITH RECURSIVE {_E}, {_pairs_sql('1.0 - {cos} <= ' + repr(float(eps)))}, "
            "und AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), "
            "deg AS (SELECT e.id, count(und.b) AS deg FROM e LEFT JOIN und ON und.a = e.id GROUP BY e.id), "
            f"core AS (SELECT id FROM deg WHERE deg + 1 >= {int(min_samples)}), "
            "cedge AS (SELECT a, b FROM und WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), "
            "reach(src, dst) AS (SELECT id, id FROM core UNION SELECT r.src, c.b FROM reach r JOIN cedge c ON c.a = r.dst), "
            "comp AS (SELECT src AS id, min(dst) AS comp FROM reach GROUP BY src), "
            "num AS (SELECT comp, (dense_rank() OVER (ORDER BY comp) - 1)::INTEGER AS cluster FROM (SELECT DISTINCT comp FROM comp)), "
            "corecl AS (SELECT comp.id, num.cluster FROM comp JOIN num USING (comp)), "
            "border AS (SELECT u.a AS id, min(c.cluster) AS cluster FROM und u JOIN corecl c ON c.id = u.b "
            "           WHERE u.a NOT IN (SELECT id FROM core) GROUP BY u.a) "
            "SELECT e.id AS vec_id, coalesce(corecl.cluster, border.cluster, -1)::INTEGER AS cluster "
            "FROM e LEFT JOIN corecl ON corecl.id = e.id LEFT JOIN border ON border.id = e.id")


def _dbscan_query(eps: float):
    def q(spark, sf):
        return CL.dbscan(_emb(spark, sf), "vec_id", "v", eps=eps, min_samples=15, metric="cosine")
    return q


for _name, _eps in (("cluster_dbscan", 0.75), ("cluster_dbscan_wide", 0.8), ("cluster_dbscan_tight", 0.2)):
    register(_name, dbscan_sql(_eps))(_dbscan_query(_eps))


def _proj_sql() -> str:
    cols = R.signed_projection_columns()
    unit = "list_transform(v, lambda x: x / sqrt(list_reduce(list_transform(v, lambda y: y * y), lambda p, q: p + q)))"
    dots = []
    for col in cols:
        lit = "[" + ", ".join(repr(w) for w in col) + "]::DOUBLE[]"
        dots.append(f"list_reduce(list_transform(list_zip({unit}, {lit}), lambda z: z[1] * z[2]), lambda x, y: x + y)")
    return (f"WITH {_E}, r AS (SELECT id, [{', '.join(dots)}] AS r FROM e) "
            f"SELECT id AS vec_id, {O.vec_text('r')} AS r FROM r")


@register("reduce_projection", _proj_sql())
def q_reduce_projection(spark, sf):
    red = R.reduce_projection(_emb(spark, sf), "vec_id", "v")
    return red.select("vec_id", V.vector_text(F.col("r")).alias("r"))


@register("reduce_pca", None)
def q_reduce_pca(spark, sf):
    red, _ = R.reduce_pca(_emb(spark, sf), "vec_id", "v", 5)
    return red.select("vec_id", F.size("r").cast("bigint").alias("dims"), V.vector_text(F.col("r")).alias("r"))


@register("cluster_density", None)
def q_cluster_density(spark, sf):
    return CL.density(_emb(spark, sf), "vec_id", "v")


# J9 against brute force: a saved DBSCAN scenario of all vectors, asked for the cluster of every
# reversed vector.
_NEAREST_EPS = 0.75


@register("nearest_cluster",
          dbscan_sql(_NEAREST_EPS).replace("SELECT e.id AS vec_id", ", cl AS (SELECT e.id AS vec_id", 1) + "), "
          "q AS (SELECT id, list_reverse(v) AS v FROM e), "
          f"s AS (SELECT q.id, cl.vec_id, cl.cluster, {O.cosine_sql('q.v', 'e.v')} AS cosine FROM q, e JOIN cl ON cl.vec_id = e.id WHERE cl.cluster <> -1) "
          f"SELECT id AS vec_id, cluster FROM s WHERE 1.0 - cosine <= {_NEAREST_EPS!r} "
          "QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, vec_id) = 1")
def q_nearest_cluster(spark, sf):
    e = _emb(spark, sf)
    model = e.join(CL.dbscan(e, "vec_id", "v", eps=_NEAREST_EPS), "vec_id").where(F.col("cluster") != L.NOISE)
    root = _scratch(spark, "dbscan")
    ST.save({"cluster_model": model.select(F.col("vec_id").alias("keyword"), F.col("v").alias("r"), "cluster")}, root, "dbscan")
    saved = ST.load(spark, root, "dbscan", ("cluster_model",))["cluster_model"]
    new = e.select(F.col("vec_id").alias("keyword"), F.reverse("v").alias("r"))
    return PR.nearest_cluster(new, saved, _NEAREST_EPS).select(F.col("keyword").alias("vec_id"), "cluster")


@register("cluster_kmeans", None)
def q_cluster_kmeans(spark, sf):
    return CL.kmeans(_emb(spark, sf), "vec_id", "v", k=10)


# ---------------------------------------------------------------- labels and topic tables
# A fixed, SQL-derivable upstream (keyword → md5 bucket of its first token,
# bucket 15 = noise) stands in for the clusterer so every later operator can be
# checked exactly; the real clusterers feed the same functions in ``build``.

class Fixed:
    def __init__(self, spark, sf):
        self.c = corpus(spark, sf)
        self.kw = cut_lineage(self.c.keywords())
        self.vocab = cut_lineage(K.vocabulary(self.kw))
        b = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.split("keyword", " ")[0]), 1, 1)) - 1
        self.kc = self.vocab.select("keyword", F.when(b == 15, F.lit(-1)).otherwise(b).cast("int").alias("cluster"))
        self.labels = cut_lineage(L.class_tfidf_labels(self.kc))
        self.kt = L.keyword_topics(self.kc, self.labels)
        self.dtp = TB.assign_topics(self.kw, self.kt)
        self.tkw = TB.topic_keywords(self.vocab, self.kt)

    @cached_property
    def topics(self) -> TB.Topics:
        return TB.topics_of(self.dtp, self.tkw)

    @property
    def tt(self) -> DataFrame:
        return self.topics.counts

    def topic_vectors(self):
        return self.c.phrase_vectors(self.labels.select("topic", F.col("topic").alias("phrase")).distinct(), "topic")


def _table_out(t: DataFrame, *more: str) -> DataFrame:
    return t.select("topic", F.col("n_documents").cast("bigint"),
                    F.concat_ws("|", F.transform("documents", lambda x: x.cast("string"))).alias("documents"),
                    F.concat_ws("|", "topic_keywords").alias("topic_keywords"), *more)


_FX = O.keywords_sql() + O.fixed_topic_ctes()


@register("cluster_sizes", O.with_(_FX) + "\nSELECT cluster, count(*)::BIGINT AS n_keywords FROM kc GROUP BY cluster")
def q_cluster_sizes(spark, sf):
    return Fixed(spark, sf).kc.groupBy("cluster").agg(F.count(F.lit(1)).cast("bigint").alias("n_keywords"))


@register("cluster_keywords",
          O.with_(_FX) + "\nSELECT cluster, string_agg(keyword, '|' ORDER BY keyword) AS keywords FROM kc WHERE cluster <> -1 GROUP BY cluster")
def q_cluster_keywords(spark, sf):
    """A4 in the form of an export; the clusters' keywords are rows everywhere else."""
    kc = L.clustered(Fixed(spark, sf).kc)
    return kc.groupBy("cluster").agg(F.concat_ws("|", F.array_sort(F.collect_list("keyword"))).alias("keywords"))


@register("cluster_labels", O.with_(_FX) + "\nSELECT cluster, topic FROM clab")
def q_cluster_labels(spark, sf):
    return Fixed(spark, sf).labels


@register("cluster_keystring",
          O.with_(_FX) + "\nSELECT cluster, string_agg(keyword, ',' ORDER BY rk) AS keystring FROM ("
          "SELECT kc.cluster, kc.keyword, row_number() OVER (PARTITION BY kc.cluster ORDER BY v.n_documents DESC, kc.keyword) AS rk "
          "FROM kc JOIN vocab v USING (keyword) WHERE kc.cluster <> -1) WHERE rk <= 50 GROUP BY cluster")
def q_cluster_keystring(spark, sf):
    fx = Fixed(spark, sf)
    return L.keystrings(fx.kc, fx.vocab)


@register("label_requests",
          O.with_(_FX) + "\nSELECT cluster, md5(" + _sql_text(L.REQUEST_TEXT) + " || keystring) AS request_md5 FROM ("
          "SELECT cluster, string_agg(keyword, ',' ORDER BY rk) AS keystring FROM ("
          "SELECT kc.cluster, kc.keyword, row_number() OVER (PARTITION BY kc.cluster ORDER BY v.n_documents DESC, kc.keyword) AS rk "
          "FROM kc JOIN vocab v USING (keyword) WHERE kc.cluster <> -1) WHERE rk <= 50 GROUP BY cluster)")
def q_label_requests(spark, sf):
    fx = Fixed(spark, sf)
    req = L.label_requests(L.keystrings(fx.kc, fx.vocab))
    return req.select("cluster", F.md5("request").alias("request_md5"))


# Replies for the parse check are derived from each cluster's label: a good
# JSON reply, a reply without ``topic``, a malformed one, and a blank one, by
# cluster number modulo 4.
_REPLY_SQL = ("CASE cluster % 4 WHEN 0 THEN '  {\"topic\": \"' || topic || ' theme\"}  ' "
              "WHEN 1 THEN '{\"label\": \"' || topic || '\"}' WHEN 2 THEN '{\"topic\" \"' || topic || '\"}' "
              "ELSE NULL END")


@register("parse_label_replies",
          O.with_(_FX) + f",\nrep AS (SELECT cluster, topic, {_REPLY_SQL} AS reply FROM clab)\n"
          "SELECT cluster, coalesce(CASE WHEN json_valid(coalesce(trim(reply), '')) "
          "THEN json_extract_string(trim(reply), '$.topic') END, topic) AS topic FROM rep")
def q_parse_replies(spark, sf):
    lab = Fixed(spark, sf).labels
    m = F.col("cluster") % 4
    reply = (F.when(m == 0, F.concat(F.lit('  {"topic": "'), F.col("topic"), F.lit(' theme"}  ')))
             .when(m == 1, F.concat(F.lit('{"label": "'), F.col("topic"), F.lit('"}')))
             .when(m == 2, F.concat(F.lit('{"topic" "'), F.col("topic"), F.lit('"}'))))
    return L.parse_replies(lab.select("cluster", reply.alias("reply")), lab)


@register("cluster_topic_table", O.with_(_FX) + "\nSELECT cluster, topic FROM clab UNION ALL SELECT -1, 'Outlier'")
def q_cluster_topic_table(spark, sf):
    return L.label_table(Fixed(spark, sf).labels)


@register("reply_topic_vectors",
          O.with_(_FX, O.topic_vector_ctes()) + ",\nrl AS (SELECT DISTINCT CASE WHEN cluster % 2 = 0 THEN upper(topic) || '!' ELSE topic END AS label, topic FROM clab)\n"
          f"SELECT rl.label AS topic, {O.vec_text('tvv.v')} AS v FROM rl JOIN tvv USING (topic)")
def q_reply_topic_vectors(spark, sf):
    """Replies for some clusters only, in capitals: all clusters keep a label, and
    every label finds its vector."""
    fx = Fixed(spark, sf)
    replies = fx.labels.where("cluster % 2 = 0").select("cluster", F.to_json(F.struct(F.concat(F.upper("topic"), F.lit("!")).alias("topic"))).alias("reply"))
    labels = L.parse_replies(replies, fx.labels)
    return fx.c.phrase_vectors(L.label_phrases(labels), "topic").select("topic", V.vector_text(F.col("v")).alias("v"))


@register("assign_topics", O.with_(_FX) + "\nSELECT doc_id, topic FROM dtp")
def q_assign_topics(spark, sf):
    return Fixed(spark, sf).dtp


@register("topic_keywords", O.with_(_FX) + "\nSELECT topic, keyword FROM tkw")
def q_topic_keywords(spark, sf):
    return Fixed(spark, sf).tkw


@register("noise_keywords", O.with_(_FX) + "\nSELECT keyword FROM vocab WHERE keyword NOT IN (SELECT keyword FROM kt)")
def q_noise_keywords(spark, sf):
    fx = Fixed(spark, sf)
    return TB.noise_keywords(fx.vocab, fx.kt)


@register("covered_docs", O.with_(_FX) + "\nSELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM dtp)")
def q_covered_docs(spark, sf):
    fx = Fixed(spark, sf)
    return TB.covered_docs(fx.c.docs, fx.dtp)


@register("topic_table", O.with_(_FX) + "\n" + O.table_select("tt"))
def q_topic_table(spark, sf):
    return _table_out(Fixed(spark, sf).topics.listed())


@register("topic_popularity",
          O.with_(_FX) + "\nSELECT topic, n_documents::BIGINT AS n_documents, "
          "(row_number() OVER (ORDER BY n_documents DESC, topic) - 1)::INTEGER AS rank FROM tt")
def q_topic_popularity(spark, sf):
    tt = Fixed(spark, sf).tt.select("topic", "n_documents")
    key = tt.select("topic", "n_documents", F.struct((-F.col("n_documents")).alias("nd"), F.col("topic").alias("t")).alias("k"))
    idx = CL.dense_index(key, "k", "rank")
    return key.join(idx, "k").select("topic", "n_documents", "rank")


@register("topic_vectors", O.with_(_FX, O.topic_vector_ctes()) + f"\nSELECT topic, {O.vec_text('v')} AS v FROM tvv")
def q_topic_vectors(spark, sf):
    return Fixed(spark, sf).topic_vectors().select("topic", V.vector_text(F.col("v")).alias("v"))


_SIMS = (O.with_(_FX, O.topic_vector_ctes(), O.token_vector_cte(name="tvall"), O.doc_vector_ctes("dvec", "tvall"))
         + ",\nsims AS (SELECT d.doc_id, d.topic, " + O.cosine_sql("dv.v", "tv.v") + " AS cosine "
         "FROM dtp d JOIN dvec dv USING (doc_id) JOIN tvv tv USING (topic))\n")


def _doc_topic_sims(fx: Fixed) -> DataFrame:
    dv = fx.c.doc_vectors().select("doc_id", F.col("v").alias("dv"))
    tv = fx.topic_vectors().select("topic", F.col("v").alias("tv"))
    return fx.dtp.join(dv, "doc_id").join(tv, "topic").select("doc_id", "topic", VF.cosine(F.col("dv"), F.col("tv")).alias("cosine"))


@register("doc_topic_similarity", _SIMS + "SELECT doc_id, topic, round(cosine, 6) AS cosine FROM sims")
def q_doc_topic_similarity(spark, sf):
    return _doc_topic_sims(Fixed(spark, sf)).withColumn("cosine", F.round("cosine", 6))


@register("topic_gate", _SIMS + f"SELECT doc_id, topic FROM sims WHERE cosine >= {TB.PREDICT_GATE!r}")
def q_topic_gate(spark, sf):
    return _doc_topic_sims(Fixed(spark, sf)).where(F.col("cosine") >= TB.PREDICT_GATE).select("doc_id", "topic")


@register("identity_mapping", O.with_(_FX) + "\nSELECT DISTINCT topic, topic AS parent FROM tt")
def q_identity_mapping(spark, sf):
    return TB.identity_mapping(Fixed(spark, sf).tt)


MAP_T = 0.4


@register("similar_topic_mapping", O.with_(_FX, O.topic_vector_ctes(), O.topic_mapping_ctes(MAP_T)) + "\nSELECT topic, parent FROM tmap")
def q_similar_topic_mapping(spark, sf):
    fx = Fixed(spark, sf)
    return TB.similar_topic_mapping(fx.tt, fx.topic_vectors(), MAP_T)


@register("apply_mapping",
          O.with_(_FX, O.topic_vector_ctes(), O.topic_mapping_ctes(MAP_T)) +
          "\nSELECT d.doc_id, coalesce(m.parent, d.topic) AS topic FROM dtp d LEFT JOIN tmap m ON m.topic = d.topic")
def q_apply_mapping(spark, sf):
    fx = Fixed(spark, sf)
    return TB.apply_mapping(fx.dtp, TB.similar_topic_mapping(fx.tt, fx.topic_vectors(), MAP_T)).select("doc_id", "topic")


@register("merge_topics",
          O.with_(_FX, O.topic_vector_ctes(), O.topic_mapping_ctes(MAP_T), O.merged_ctes()) + "\n" + O.table_select("mtt"))
def q_merge_topics(spark, sf):
    fx = Fixed(spark, sf)
    return _table_out(TB.merge_topics(fx.dtp, fx.tkw, TB.similar_topic_mapping(fx.tt, fx.topic_vectors(), MAP_T)).listed())


@register("collapse_topics",
          O.with_(_FX, O.topic_vector_ctes(), O.topic_mapping_ctes(TB.COLLAPSE_THRESHOLD), O.merged_ctes()) + "\n" + O.table_select("mtt"))
def q_collapse_topics(spark, sf):
    fx = Fixed(spark, sf)
    merged, _ = TB.collapse(fx.topics, fx.topic_vectors(), TB.COLLAPSE_THRESHOLD)
    return _table_out(merged.listed())


# ---------------------------------------------------------------- build, store, predict

from . import build as B  # noqa: E402
from . import predict as PR  # noqa: E402
from ..sources import store as ST  # noqa: E402
from ..session import ensure_checkpoint_dir  # noqa: E402
import os  # noqa: E402
import uuid  # noqa: E402

FLAGSHIP = B.Params()


def _scratch(spark, what: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "tessera-runs", f"{what}-{uuid.uuid4().hex}")


def _built(spark, sf, p: B.Params = FLAGSHIP, scenario: str = "flagship"):
    root = _scratch(spark, "scenario")
    out, b = B.build_topics(language_corpus(spark, sf), scenario, p, root=root)
    return out, b, root


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    out, _, _ = _built(spark, sf)
    return _table_out(B.tagged(out, "flagship"), "scenario")


@register("build_topics", None)
def q_build_topics(spark, sf):
    return flagship(spark, sf)


@register("topic_modelling", None)
def q_topic_modelling(spark, sf):
    b = B.topic_modelling(language_corpus(spark, sf), FLAGSHIP)
    return _table_out(b.topics.listed())


@register("predict_topics", None)
def q_predict_topics(spark, sf):
    _, _, root = _built(spark, sf)
    new = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    pred = PR.predict_topics(spark, new, root, "flagship", eps=0.2)
    pred = TB.with_keywords(pred, PR.parent_keywords(ST.load(spark, root, "flagship")))
    return pred.select("doc_id", "topic", F.concat_ws("|", "topic_keywords").alias("topic_keywords"))


@register("predict_clusters", None)
def q_predict_clusters(spark, sf):
    """J9 + G2: benchmark keywords reduced with the stored reducer and given the
    cluster of the nearest stored keyword (the scenario is an HDBSCAN one)."""
    _, _, root = _built(spark, sf)
    t = ST.load(spark, root, "flagship")
    new = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    nc = PR.new_corpus(new, t)
    vocab = nc.keywords().select("keyword").distinct()
    kvec = V.phrase_vectors(vocab.select("keyword", F.col("keyword").alias("phrase")), "keyword",
                            t["term_stats"], t["token_vectors"])
    red = R.reduce_with(kvec, "keyword", "v", t["reducer"])
    return PR.assign_clusters(spark, red, t, root, "flagship", 0.2)


@register("reduce_new", None)
def q_reduce_new(spark, sf):
    """Fit PCA on the embeddings, apply the stored model table to all of them."""
    e = _emb(spark, sf)
    _, matrix = R.reduce_pca(e, "vec_id", "v", 5)
    red = R.reduce_with(e, "vec_id", "v", matrix)
    return red.select("vec_id", F.size("r").cast("bigint").alias("dims"), V.vector_text(F.col("r")).alias("r"))


def _fixed_saved(spark, sf, threshold: float):
    fx = Fixed(spark, sf)
    tv = cut_lineage_(fx.topic_vectors())
    merged, mapping = TB.collapse(fx.topics, tv, threshold)
    root = _scratch(spark, "fixed")
    params = spark.createDataFrame([(float(threshold), int(fx.c.n_docs))], "threshold DOUBLE, n_docs BIGINT")
    ST.save({"topics": fx.tt, "topic_doc": fx.topics.documents, "topic_keyword": fx.topics.keywords, "topic_vectors": tv, "mapping": mapping, "params": params,
             "keyword_topic": fx.kt}, root, "fixed")
    return fx, root


def cut_lineage_(df):
    from ..session import cut_lineage
    return cut_lineage(df)


_SAVED = ("topics", "topic_doc", "topic_keyword", "topic_vectors", "mapping", "params", "keyword_topic")


@register("save_load_roundtrip", O.with_(_FX) + "\n" + O.table_select("tt"))
def q_save_load(spark, sf):
    _, root = _fixed_saved(spark, sf, TB.COLLAPSE_THRESHOLD)
    return _table_out(B.topics_from(ST.load(spark, root, "fixed", _SAVED)).listed())


@register("output_as_text",
          O.with_(_FX) + "\nSELECT topic, n_documents::BIGINT AS n_documents, array_to_string(documents, ', ') AS documents, "
          "array_to_string(topic_keywords, ', ') AS topic_keywords FROM tt")
def q_output_as_text(spark, sf):
    fx = Fixed(spark, sf)
    path = _scratch(spark, "text")
    ST.write_text(fx.topics.listed(), path)
    return spark.read.option("header", True).csv(path).select(
        "topic", F.col("n_documents").cast("bigint"), "documents", "topic_keywords")


@register("output_from_text", O.with_(_FX) + "\n" + O.table_select("tt"))
def q_output_from_text(spark, sf):
    fx = Fixed(spark, sf)
    path = _scratch(spark, "text")
    ST.write_text(fx.topics.listed(), path)
    back = ST.read_text(spark, path).withColumn("n_documents", F.col("n_documents").cast("bigint"))
    return back.select("topic", "n_documents",
                       F.concat_ws("|", "documents").alias("documents"), F.concat_ws("|", "topic_keywords").alias("topic_keywords"))


@register("reload_topics",
          O.with_(_FX, O.topic_vector_ctes(), O.topic_mapping_ctes(TB.COLLAPSE_THRESHOLD), O.merged_ctes()) +
          "\nSELECT *, 'fixed' AS scenario FROM (" + O.table_select("mtt") + ")")
def q_reload_topics(spark, sf):
    _, root = _fixed_saved(spark, sf, TB.COLLAPSE_THRESHOLD)
    return _table_out(B.tagged(B.reload_topics(spark, root, "fixed"), "fixed"), "scenario")


@register("recollapse_topics",
          O.with_(_FX, O.topic_vector_ctes(), O.topic_mapping_ctes(MAP_T), O.merged_ctes()) +
          "\nSELECT *, 'fixed' AS scenario FROM (" + O.table_select("mtt") + ")")
def q_recollapse_topics(spark, sf):
    """Collapse the saved scenario anew, then reload it with the map that was saved."""
    _, root = _fixed_saved(spark, sf, TB.COLLAPSE_THRESHOLD)
    B.recollapse(spark, root, "fixed", MAP_T)
    return _table_out(B.tagged(B.reload_topics(spark, root, "fixed"), "fixed"), "scenario")


@register("predict_by_keyword",
          O.with_(_FX, O.topic_vector_ctes(), O.topic_mapping_ctes(TB.COLLAPSE_THRESHOLD),
                  O.new_doc_keywords_sql("benchmark", "item_id", "text")) +
          "\nSELECT DISTINCT k.doc_id, coalesce(m.parent, kt.topic) AS topic FROM b_kw k JOIN kt USING (keyword) "
          "LEFT JOIN tmap m ON m.topic = kt.topic")
def q_predict_by_keyword(spark, sf):
    fx, root = _fixed_saved(spark, sf, TB.COLLAPSE_THRESHOLD)
    t = ST.load(spark, root, "fixed", _SAVED)
    t["term_stats"] = fx.c.stats
    new = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    nk = PR.new_corpus(new, t).keywords()
    return PR.predict_by_keyword(nk, t["keyword_topic"], t["mapping"])


@register("stream_by_keyword",
          O.with_(_FX, O.topic_vector_ctes(), O.topic_mapping_ctes(TB.COLLAPSE_THRESHOLD), O.phrase_ctes("benchmark", "item_id", "text")) +
          "\nSELECT DISTINCT ph.doc_id, coalesce(m.parent, kt.topic) AS topic FROM ph JOIN kt USING (keyword) "
          "LEFT JOIN tmap m ON m.topic = kt.topic")
def q_stream_by_keyword(spark, sf):
    """X1 as a stream plan: benchmark files against the keywords of the saved topics."""
    from ..streaming import predict_stream as PS
    _, root = _fixed_saved(spark, sf, TB.COLLAPSE_THRESHOLD)
    return PS.run_by_keyword(spark, os.path.join(sf, "benchmark*.parquet"), table(spark, sf, "benchmark").schema, root, "fixed",
                             _scratch(spark, "sink"), _scratch(spark, "ckpt"), id_col="item_id")


@register("predict_stream", None)
def q_predict_stream(spark, sf):
    """Benchmark rows as a file stream, scored per micro-batch; equals the
    batch ``predict_topics`` result."""
    from ..streaming import predict_stream as PS
    _, _, root = _built(spark, sf)
    src = os.path.join(sf, "benchmark*.parquet")
    schema = table(spark, sf, "benchmark").schema
    out = PS.run_available(spark, src, schema, root, "flagship", _scratch(spark, "sink"), _scratch(spark, "ckpt"),
                           id_col="item_id", text_col="text", eps=0.2)
    out = TB.with_keywords(out, PR.parent_keywords(ST.load(spark, root, "flagship")))
    return out.select("doc_id", "topic", F.concat_ws("|", "topic_keywords").alias("topic_keywords"))
