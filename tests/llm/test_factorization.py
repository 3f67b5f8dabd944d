import zlib

import numpy as np
import pytest

from tessera.llm import common as C
from tessera.llm import factorization as X
from tessera.llm import stages


def test_linear_time_identity():
    """Logits equal the double sum over all feature pairs."""
    rng = np.random.default_rng(1)
    texts = ["some words here here.", "", "ÜNÏ x # 12\nx\nx", "a"]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    edge, bucket, value, stats = X.features(np.frombuffer(b"".join(raw), np.uint8), offs, C.Rolling(3))
    n = X.BUCKETS + X.N_STATS
    m = X.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, 3)), np.zeros(X.N_STATS), np.ones(X.N_STATS))
    got = m.logits(edge, bucket, value, stats)
    for r in range(len(texts)):
        x = np.zeros(n)
        x[bucket[edge[r]:edge[r + 1]]] = value[edge[r]:edge[r + 1]]
        x[X.BUCKETS:] = m.standard(stats)[r]
        at = np.flatnonzero(x)
        want = 0.3 + m.w @ x + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in at for j in at if i < j)
        assert got[r] == pytest.approx(want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = X.op3_factorization(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    good = [r for r in held if r.quality == 1]
    bad = [r for r in held if r.quality == 0]
    assert len(bad) > 50
    assert sum(r.predicted for r in good) >= 0.99 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.9 * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_messy(spark, messy, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (8, 0, 0), (None, 1, 0), (9, None, None), (10, 1, 0), (13, 0, 0), (77, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    out = X.classify(messy, X.train(messy, labels)).collect()
    assert len(out) == messy.count() and all(0 <= r.score <= 1 for r in out)
    none = labels.limit(0)
    assert {r.score for r in X.classify(messy, X.train(messy, none)).collect()} == {0.5}
    assert X.classify(nothing, X.train(nothing, labels)).collect() == []


def test_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stages.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in X.op3_factorization(spark, sf).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) < docs.count()
