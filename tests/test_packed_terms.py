"""Packed documents against a plain version with a row for each position."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as VF
from tessera.operators import keywords as K
from tessera.operators import terms as TR
from tessera.operators import vectors as V
from tessera.plans.corpus import Corpus

# ids 2 and null stand in two rows each, 2 with equal first positions; 4 and 5 have no token
TEXTS = [(1, "river bank river water"), (2, "stone bridge stone"), (2, "stone tower bridge river"), (None, "water mill"), (None, "mill stone mill"),
         (3, "bridge"), (4, ""), (5, None), (6, "unseen river words river stone")]


def plain(rows, n_docs, df=None):
    """{doc_id: [(token, idf, wd)]} and {doc_id: norm}, from rows of (doc_id, content)."""
    parts = {}
    for d, content in rows:
        for pos, token in enumerate(content):
            parts.setdefault(d, []).append((pos, token))
    known = df or {}
    if df is None:
        for entries in parts.values():
            for t in {t for _, t in entries}:
                known[t] = known.get(t, 0) + 1
    idf = lambda t: math.log((n_docs + 1.0) / (known.get(t, 0) + 1.0)) + 1.0
    seqs, norms = {}, {}
    for d, entries in parts.items():
        tf, least = {}, {}
        for pos, t in entries:
            tf[t] = tf.get(t, 0) + 1
            least[t] = min(pos, least.get(t, pos))
        seqs[d] = [(t, idf(t), tf[t] * idf(t)) for _, t in sorted(entries)]
        norms[d] = math.sqrt(sum((tf[t] * idf(t)) ** 2 for t in sorted(t for pos, t in entries if pos == least[t])))
    return seqs, norms


@pytest.mark.parametrize("slice_tokens", [1 << 18, 3])
def test_sequences(spark, monkeypatch, slice_tokens):
    monkeypatch.setattr(TR, "SLICE_TOKENS", slice_tokens)
    docs = spark.createDataFrame(TEXTS, "doc_id LONG, text STRING")
    c = Corpus(docs)
    content = [(r.doc_id, r.content) for r in c.prepared.collect()]
    seqs, norms = plain(content, len(TEXTS))
    got = c.sequences.collect()
    assert len(got) == len(seqs)
    for r in got:
        assert [e.token for e in r.seq] == [t for t, _, _ in seqs[r.doc_id]]
        assert [x for e in r.seq for x in (e.idf, e.wd)] == pytest.approx([x for _, i, w in seqs[r.doc_id] for x in (i, w)], rel=1e-15)
        assert r.dnorm == pytest.approx(norms[r.doc_id], rel=1e-15)
    rows = c.weighted.collect()
    assert sorted((str(r.doc_id), r.token, r.tf) for r in rows) == sorted((str(r.doc_id), r.token, r.tf) for r in c.terms.collect())
    assert {(r.doc_id, r.token): r.wd for r in rows} == pytest.approx({(d, t): w for d, s in seqs.items() for t, _, w in s}, rel=1e-15)
    # new documents against another corpus, with tokens it never saw
    old = Corpus(docs.where("doc_id < 4"))
    new = Corpus(docs, n_docs=old.n_docs, stats=old.stats)
    df = {r.token: r.df for r in old.stats.collect()}
    seqs, _ = plain(content, old.n_docs, df)
    assert {r.doc_id: [e.idf for e in r.seq] for r in new.sequences.collect()} == {d: pytest.approx([i for _, i, _ in s], rel=1e-15) for d, s in seqs.items()}


def test_no_token(spark):
    c = Corpus(spark.createDataFrame([("a", ""), ("b", None)], "doc_id STRING, text STRING"))
    assert c.sequences.collect() == [] and c.keywords().collect() == [] and c.doc_vectors().collect() == []


def test_positions_are_no_rows(spark):
    c = Corpus(spark.createDataFrame(TEXTS, "doc_id LONG, text STRING"))
    plan = c.sequences._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "positions" not in plan
    assert "regexp" not in c.terms._jdf.queryExecution().optimizedPlan().toString()  # texts were cleaned once


def test_signatures(spark):
    import hashlib
    rows = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (None, "a", 5), (-7, "b", 1)], "doc_id LONG, token STRING, tf LONG")
    sign = lambda d, j: (int(hashlib.md5(str(d).encode()).hexdigest()[j // 4], 16) >> j % 4 & 1) * 2 - 1
    want = {"a": [2 * sign(1, j) + sign(2, j) for j in range(V.DIM)], "b": [sign(-7, j) for j in range(V.DIM)]}
    assert {r.token: list(r.tv) for r in V.token_vectors(rows).collect()} == want
    own = rows.withColumn("sig", V.signature(F.col("doc_id"))).drop("doc_id")
    assert {r.token: list(r.tv) for r in V.token_vectors(own).collect()} == want


def test_normalised(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v ARRAY<DOUBLE>")
    assert [r.u for r in rows.select(VF.l2_normalize(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]
    # one sum for a vector, not one for each of its elements
    assert rows.select(VF.l2_normalize(F.col("v")).alias("u"))._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_picks(rng=np.random.default_rng(3)):
    """Candidates that share a token with the picked one against a look at all of them."""
    for _ in range(40):
        code = np.unique(rng.integers(0, 30, int(rng.integers(1, 80))), return_inverse=True)[1]
        idf = rng.choice([1.0, 1.5, 7.123], code.max() + 1)
        wd = idf * np.bincount(code)
        tok, w, norm, rel = K._relevance(K._candidates(code, 3), idf, wd, float(np.sqrt((wd * wd).sum())))
        maxsim, want = np.zeros(len(rel)), []
        for r in range(min(10, len(rel))):
            score = rel.copy() if r == 0 else 0.6 * rel - 0.4 * maxsim
            score[want] = -np.inf
            p = int(np.argmax(score))
            want.append(p)
            acc = np.zeros(len(rel))
            for j in range(3):
                for k in range(3):
                    if tok[p, k] >= 0:
                        acc = acc + np.where(tok[:, j] == tok[p, k], w[:, j] * w[p, k], 0.0)
            maxsim = np.maximum(maxsim, acc / (norm * norm[p]))
        assert K._mmr_picks(rel, norm, tok, w, 10, 0.4) == want
