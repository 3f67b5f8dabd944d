"""Document vectors in slices against sums over all (document, token) rows."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors as V
from tessera.plans.corpus import Corpus
from tessera.session import stored, table


def plain(weighted, tvecs):
    tv = {r.token: list(r.tv) for r in tvecs.collect()}
    sums = {}
    for r in weighted.collect():
        if r.token in tv:
            v = sums.setdefault(r.doc_id, [0.0] * V.DIM)
            for j, x in enumerate(tv[r.token]):
                v[j] += r.wd * x
    norm = {d: math.sqrt(sum(x * x for x in v)) for d, v in sums.items()}
    return {d: [x / norm[d] if norm[d] else 0.0 for x in v] for d, v in sums.items()}


def check(got, want):
    rows = {r.doc_id: list(r.v) for r in got.collect()}
    assert rows.keys() == want.keys()
    for d, v in rows.items():
        assert v == pytest.approx(want[d], abs=1e-9)


@pytest.mark.parametrize("slice_docs, sum_rows", [(1024, 1 << 16), (7, 5)])
def test_documents(spark, monkeypatch, slice_docs, sum_rows):
    monkeypatch.setattr(V, "SLICE_DOCS", slice_docs)
    c = Corpus(table(spark, "/root/testdata/sf0.001", "documents")).materialize("terms")
    check(c.doc_vectors(), plain(c.weighted, c.token_vectors()))


def test_edges(spark):
    rows = stored(spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "x", 3.0), (None, "a", 1.0), (None, "b", 0.0), (3, "zero", 1.0), (4, "b", -1.0)],
                                        "doc_id LONG, token STRING, wd DOUBLE"), "rows")
    tv = spark.createDataFrame([("a", [1] * V.DIM), ("b", [j for j in range(V.DIM)]), ("zero", [0] * V.DIM)], "token STRING, tv ARRAY<BIGINT>")
    check(V.doc_vectors(rows, tv, 5), plain(rows, tv))  # 2 has no known token, 3 has the zero vector
    assert V.doc_vectors(rows.where("false"), tv, 0).collect() == []
    assert V.doc_vectors(rows, tv.where("false"), 5).collect() == []
    text = spark.createDataFrame([("k", "a", 1.0)], "doc_id STRING, token STRING, wd DOUBLE")
    check(V.doc_vectors(text, tv, 1), plain(text, tv))


def test_no_wide_row_of_a_pair_is_moved(spark):
    rows = stored(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("hot").alias("token"), F.lit(1.0).alias("wd")), "hot")
    tv = stored(spark.createDataFrame([("hot", [1] * V.DIM)], "token STRING, tv ARRAY<BIGINT>"), "tv")
    plan = V.doc_vectors(rows, tv, 50)
    assert plan.count() == 50
    moved = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(moved) == 1  # only distinct (slice, token) rows meet vectors
    assert "Aggregate" in plan._jdf.queryExecution().optimizedPlan().toString()
