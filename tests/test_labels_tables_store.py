import pytest
from pyspark.sql import functions as F

from tessera.operators import labels as L
from tessera.operators import tables as TB
from tessera.sources import store as ST


def test_labels_reference_case(spark):
    kc = spark.createDataFrame([("galaxy", 0), ("stars", 0), ("outlier_kw", -1)], "keyword STRING, cluster INT")
    labels = L.class_tfidf_labels(kc)
    kt = {r["keyword"]: r["topic"] for r in L.keyword_topics(kc, labels).collect()}
    assert set(kt) == {"galaxy", "stars"} and kt["galaxy"] == kt["stars"] and kt["galaxy"].strip()
    assert [r["cluster"] for r in labels.collect()] == [0]


def test_parse_replies(spark):
    rep = spark.createDataFrame([(0, ' {"topic": "Solar power"} '), (1, '{"label": "x"}'), (2, '{"topic" "x"}'),
                                 (3, None)], "cluster INT, reply STRING")
    fb = spark.createDataFrame([(1, "fb one"), (2, "fb two"), (3, "fb three")], "cluster INT, topic STRING")
    got = {r["cluster"]: r["topic"] for r in L.parse_replies(rep, fb).collect()}
    assert got == {0: "Solar power", 1: "fb one", 2: "fb two", 3: "fb three"}
    nofb = {r["cluster"]: r["topic"] for r in L.parse_replies(rep).collect()}
    assert nofb[1] == L.FAILED_LABEL


def test_merge_and_identity(spark):
    dt = spark.createDataFrame([("A", 1), ("A", 2), ("B", 2), ("B", 3), ("C", 4)], "topic STRING, doc_id LONG")
    tk = spark.createDataFrame([("A", "x"), ("B", "y"), ("B", "x")], "topic STRING, keyword STRING")
    m = spark.createDataFrame([("A", "A"), ("B", "A"), ("C", "C")], "topic STRING, parent STRING")
    got = {r["topic"]: (r["n_documents"], list(r["documents"]), list(r["topic_keywords"]))
           for r in TB.merge_topics(dt, tk, m).listed().collect()}
    assert got == {"A": (3, [1, 2, 3], ["x", "y"]), "C": (1, [4], [])}
    same, ident = TB.collapse(TB.topics_of(dt, tk), None, threshold=1.0)
    assert sorted(map(tuple, ident.collect())) == [("A", "A"), ("B", "B"), ("C", "C")]
    assert sorted(r["topic"] for r in same.listed().collect()) == ["A", "B", "C"]


def test_store_roundtrip_and_text(spark, tmp_path):
    tt = spark.createDataFrame([("t, one", 2, [1, 2], ["a", "b,c"]), ("t2", 1, [3], [])],
                               "topic STRING, n_documents LONG, documents ARRAY<LONG>, topic_keywords ARRAY<STRING>")
    root = str(tmp_path / "store")
    ST.save({"topic_table": tt}, root, "s1")
    assert ST.missing(spark, root, "s1", ("topic_table", "mapping")) == ["mapping"]
    back = ST.load(spark, root, "s1", ("topic_table",))["topic_table"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tt.collect()))
    ST.write_text(tt, str(tmp_path / "csv"))
    txt = {r["topic"]: list(r["topic_keywords"]) for r in ST.read_text(spark, str(tmp_path / "csv")).collect()}
    assert txt["t2"] == [] and txt["t, one"] == ["a", "b", "c"]  # commas inside cells are lost in text form


def test_a_save_that_fails_leaves_the_old_version(spark, tmp_path):
    """A crash between two tables, then a save of one table, then of all."""
    root = str(tmp_path / "store")
    one, two = (spark.createDataFrame([(i,)], "x INT") for i in (1, 2))
    ST.save({"topics": one, "mapping": one}, root, "s", "mark 1")
    broken = two.select(F.raise_error(F.lit("lost")).cast("int").alias("x"))
    with pytest.raises(Exception, match="lost"):
        ST.save({"topics": two, "mapping": broken}, root, "s", "mark 2")
    read = lambda: {n: df.first()["x"] for n, df in ST.load(spark, root, "s", ("topics", "mapping")).items()}
    assert read() == {"topics": 1, "mapping": 1} and ST.manifest(spark, root, "s")[1] == "mark 1"
    ST.save({"mapping": two}, root, "s", keep=True)
    assert read() == {"topics": 1, "mapping": 2} and ST.manifest(spark, root, "s")[1] == "mark 1"
    ST.save({"topics": two}, root, "s", "mark 2")
    assert ST.missing(spark, root, "s", ("topics", "mapping")) == ["mapping"] and ST.manifest(spark, root, "s")[:2] == (3, "mark 2")


def test_no_lists_on_the_way(spark):
    """Merging and collapsing gather no topic in a cell."""
    dt = spark.createDataFrame([("A", 1), ("A", 2), ("B", 2)], "topic STRING, doc_id LONG")
    tk = spark.createDataFrame([("A", "x"), ("B", "y")], "topic STRING, keyword STRING")
    merged = TB.merge_topics(dt, tk, TB.identity_mapping(dt))
    for df in (merged.counts, merged.documents, merged.keywords):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_" not in plan and "CartesianProduct" not in plan


def test_replies_for_some_clusters(spark):
    fb = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "cluster INT, topic STRING")
    rep = spark.createDataFrame([(0, '{"topic": "X"}'), (0, '{"topic": "Y"}'), (2, '{"topic": " "}')], "cluster INT, reply STRING")
    assert {r["cluster"]: r["topic"] for r in L.parse_replies(rep, fb).collect()} == {0: "X", 1: "b", 2: "c"}


def test_outlier_row_and_cleaned_labels(spark):
    t = spark.createDataFrame([(0, "Solar Power!"), (1, "the")], "cluster INT, topic STRING")
    assert {r["cluster"]: r["topic"] for r in L.label_table(t).collect()} == {0: "Solar Power!", 1: "the", -1: "Outlier"}
    assert {r["topic"]: r["phrase"] for r in L.label_phrases(t).collect()} == {"Solar Power!": "solar power", "the": ""}


def test_unicode_blanks(spark):
    from tessera.sources import corpus as S
    texts = ["\u00a0", "\u2003\u3000", "\x1c \x85", "", None, "\u00a0x", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    want = {i for i, t in enumerate(texts) if t and t.strip()}
    assert {r["doc_id"] for r in S.nonblank(docs).collect()} == want


def test_topic_without_vector_is_its_own_parent(spark):
    topics = spark.createDataFrame([("A", 3), ("B", 2), ("C", 1)], "topic STRING, n_documents LONG")
    vecs = spark.createDataFrame([("A", [1.0, 0.0, 0.0]), ("B", [1.0, 0.01, 0.0])], "topic STRING, v ARRAY<DOUBLE>")
    got = {r["topic"]: r["parent"] for r in TB.similar_topic_mapping(topics, vecs, 0.85).collect()}
    assert got == {"A": "A", "B": "A", "C": "C"}
