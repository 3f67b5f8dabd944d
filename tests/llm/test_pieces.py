import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pieces as X
from tessera.llm import stages


@pytest.fixture(scope="module")
def vocab():
    return X.load()


@pytest.fixture(scope="module")
def encoder(vocab):
    return X.Encoder(vocab)


def run(enc, texts, keys):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, at = enc.encode(np.frombuffer(b"".join(raw), np.uint8), offs, np.array(keys, dtype=np.int64))
    return [ids[a:b] for a, b in zip(at, at[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5), st.integers(0, 1000))
def test_lossless(encoder, texts, key):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for t, ids in zip(texts, run(encoder, texts, [key + i for i in range(len(texts))])):
        assert encoder.decode(ids).tobytes().decode() == t


def segmentations(word, pieces):
    if not word:
        return [()]
    return [(p, *rest) for n in range(1, len(word) + 1) if (p := word[:n]) in pieces for rest in segmentations(word[n:], pieces)]


def test_probabilities_equal_enumeration(vocab):
    enc = X.Encoder(vocab, alpha=0.3)
    weight = {}
    for t, w, i in zip(vocab.texts, enc.weight, vocab.ids):
        if t not in weight or w > weight[t][0]:
            weight[t] = (w, int(i))
    word = b" there"
    all_of = {tuple(weight[p][1] for p in s): math.exp(sum(weight[p][0] for p in s)) for s in segmentations(word, weight)}
    total = sum(all_of.values())
    n = 40_000
    got = Counter(tuple(x.tolist()) for x in run(enc, [word.decode()] * n, range(n)))
    assert set(got) <= set(all_of) and len(all_of) > 20
    for s, mass in all_of.items():
        p = mass / total
        assert abs(got[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_reproducible_in_any_slicing(encoder):
    texts = ["the same text twice", "x y  z\n\n", "the same text twice"]
    together = run(encoder, texts, [4, 5, 6])
    assert [x.tolist() for x in together] == [run(encoder, [t], [k])[0].tolist() for t, k in zip(texts, [4, 5, 6])]
    assert any(run(encoder, [texts[0]], [k])[0].tolist() != together[0].tolist() for k in range(20))


def test_messy(spark, messy, nothing, vocab):
    rows = X.encode_checked(messy, vocab).collect()
    assert len(rows) == messy.count() and all(r.lossless and r.n_pieces == len(r.piece_ids) for r in rows)
    assert X.encode_checked(nothing, vocab).collect() == []
    back = X.decode(X.encode(messy.drop("_row"), vocab), vocab).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def test_op_and_stage(spark, sf, messy):
    out = X.op6_pieces(spark, sf).collect()
    assert all(r.lossless for r in out) and len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    staged = stages.pieces(spark, messy.withColumnRenamed("key", "n_pieces"), "")
    assert staged.columns[-2:] == ["piece_ids", "n_pieces_"] and staged.count() == messy.count()
