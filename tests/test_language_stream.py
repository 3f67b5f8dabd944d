"""Stop words by language, and prediction by keyword as a stream plan."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tessera import oracle as O
from tessera.functions import stopwords as SW
from tessera.plans import predict as PR
from tessera.plans.corpus import Corpus
from tessera.session import ensure_checkpoint_dir, table
from tessera.sources import store as ST
from tessera.streaming import predict_stream as PS

SF = "/root/testdata/sf0.001"


def contents(docs, **kw):
    return {r.doc_id: r.content for r in Corpus(docs, **kw).prepared.collect()}


def test_lists_are_the_public_ones(spark):
    lists = SW.stop_words_by_language(("de", "en", "es", "fr"))
    assert lists["en"] == SW.cleaned_stop_words()
    for code, words in lists.items():
        assert words == SW.cleaned_stop_words(O.public_words(SW.LISTS[code])) and words == sorted(set(words))
    assert "fur" in lists["de"] and "uber" in lists["de"] and "etaient" in lists["fr"]  # cleaned like tokens


def test_each_row_by_its_language(spark):
    text = "the river und der Fluss über dem Wald la rivière était"
    docs = spark.createDataFrame([(0, text, "en"), (1, text, "de"), (2, text, "fr"), (3, text, None), (4, text, "xx"), (5, None, "de"), (6, "", None)],
                                 "id LONG, body STRING, tongue STRING")
    lists = SW.stop_words_by_language(("en", "de", "fr"))
    got = contents(docs, id_col="id", text_col="body", stop_words=lists, lang_col="tongue")
    tokens = "the river und der fluss uber dem wald la riviere etait".split()
    for i, code in enumerate(("en", "de", "fr", "en", "en")):
        assert got[i] == [t for t in tokens if t not in lists[code]]
    assert got[5] == [] and got[6] == []
    # a list of one's own for the rest, and no language column at all
    rest = contents(docs, id_col="id", text_col="body", stop_words={**lists, "": ["river"]}, lang_col="tongue")
    assert rest[3] == rest[4] == [t for t in tokens if t != "river"] and rest[1] == got[1]
    assert contents(docs, id_col="id", text_col="body", stop_words=lists)[1] == got[0]


def test_stays_in_the_row(spark):
    docs = table(spark, SF, "documents")
    plan = Corpus(docs, stop_words=SW.stop_words_by_language(("de", "fr")), lang_col="lang").prepared
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text and "Python" not in text


@pytest.fixture
def scenario(spark):
    root = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    keywords = [("rio grande", "rivers"), ("fluss", "rivers"), ("bank", "money"), ("wald", "woods")]
    tables = {"keyword_topic": spark.createDataFrame(keywords, "keyword STRING, topic STRING"),
              "mapping": spark.createDataFrame([("rivers", "nature"), ("woods", "nature")], "topic STRING, parent STRING"),
              "params": spark.createDataFrame([('{"de": ["der", "im"], "en": ["the"]}',)], "stop_words STRING")}
    ST.save(tables, root, "s")
    return root


def test_files_arrive_and_the_query_restarts(spark, scenario):
    schema = "doc_id LONG, text STRING, lang STRING"
    texts = ["Der Fluss im Wald", "the bank", "Rio the Grande", "rio der grande", None, "", "nothing here", "bank bank fluss"]
    rows = [(i, texts[i % len(texts)], ("de", "en", "en", "en", "de", None, None, None)[i % len(texts)]) for i in range(40)]
    source, sink, mark = (os.path.join(scenario, x) for x in ("in", "out", "ckpt"))

    def arrive(some):
        for part in some:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        typed = spark.createDataFrame([], schema).schema
        return PS.run_by_keyword(spark, source, typed, scenario, "s", sink, mark, lang_col="lang", files_per_batch=1)
    arrive([rows[0:8], rows[8:16], rows[16:24]])
    first = {(r.doc_id, r.topic) for r in run().collect()}
    arrive([rows[24:32], rows[32:40]])
    second = run()
    got = sorted((r.doc_id, r.topic) for r in second.collect())
    t = ST.load(spark, scenario, "s", PS.KEYWORD_TABLES)
    batch = PS.keyword_stream(spark.createDataFrame(rows, schema), t, lang_col="lang")
    assert got == sorted({(r.doc_id, r.topic) for r in batch.collect()})
    assert first == {x for x in got if x[0] < 24}
    of = {0: {"nature"}, 1: {"money"}, 2: {"nature"}, 7: {"money", "nature"}}
    assert got == sorted((i, topic) for i in range(40) for topic in of.get(i % 8, ()))
    # a run with nothing new adds nothing, and no row was written twice
    n = spark.read.parquet(sink).count()
    run()
    assert spark.read.parquet(sink).count() == n == batch.count()


def test_batch_equals_prediction_by_keyword(spark, scenario):
    t = ST.load(spark, scenario, "s", PS.KEYWORD_TABLES)
    docs = spark.createDataFrame([(1, "fluss bank"), (2, "wald")], "doc_id LONG, text STRING")
    found = PR.phrases(docs)
    want = PR.predict_by_keyword(found, t["keyword_topic"], t["mapping"])
    got = PS.keyword_stream(docs, t).select("doc_id", "topic").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, "money"), (1, "nature"), (2, "nature")]


def test_no_article_is_a_keyword(spark):
    lists = SW.stop_words_by_language(("de", "en", "es", "fr"))
    docs = table(spark, SF, "documents")
    kw = Corpus(docs, stop_words=lists, lang_col="lang").keywords().join(docs.select("doc_id", "lang"), "doc_id")
    used = kw.select("lang", F.explode(F.split("keyword", " ")).alias("w")).distinct().collect()
    assert used and not [r for r in used if r.w in lists.get(r.lang, ())]
