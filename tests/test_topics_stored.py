"""Topic tables are stored, so that their many readers do not make them anew."""

from tessera.operators import tables as TB


def test_topics_are_computed_once(spark):
    dtp = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (None, "y")], "doc_id LONG, topic STRING")
    kws = spark.createDataFrame([("x", "k"), ("y", "l")], "topic STRING, keyword STRING")
    t = TB.topics_of(dtp, kws)
    assert [tuple(r) for r in t.counts.collect()] == [("x", 2)]
    for frame in (t.counts, t.documents):
        assert "Aggregate" not in frame._jdf.queryExecution().optimizedPlan().toString()
