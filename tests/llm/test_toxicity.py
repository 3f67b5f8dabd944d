import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import common as C
from tessera.llm import toxicity as X

WORDS = [b"stupid", b"stxupid", b"idiot", b"aaaaaaa", b"abababab", b"that", b"thereting", b"abc", b"", "réeuxpa".encode(), b"s"]


def phi(word):
    """All subsequences of four bytes in seven, the mark of the start among them."""
    s, out = b"^" + word, defaultdict(float)
    for places in combinations(range(len(s)), X.ORDER):
        gaps = places[-1] - places[0] - X.ORDER + 1
        if gaps <= X.GAPS:
            out[bytes(s[i] for i in places)] += X.DECAY ** gaps
    return out


def kernel(a, b):
    dot = lambda x, y: sum(v * y.get(k, 0.0) for k, v in x.items())
    x, y = phi(a), phi(b)
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y else 0.0


def test_kernel_equals_brute_force():
    marks = [b"stupid", b"abab", b"aaaa", b"that"]
    land = X.Landmarks(marks)
    want = np.array([[kernel(w, m) for m in marks] for w in WORDS])
    assert land.kernels(*X.packed(WORDS)) == pytest.approx(want)
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    f = land.features(*X.packed(marks))
    assert f @ f.T == pytest.approx(gram)  # Nyström is exact on the landmarks
    assert X.own_kernel(*X.packed(WORDS)) == pytest.approx([sum(v * v for v in phi(w).values()) for w in WORDS])


def test_folded_weights_give_the_margins():
    marks = [b"stupid", b"abab", b"idiot", b"that"]
    land = X.Landmarks(marks)
    f = land.features(*X.packed(WORDS))
    toxic, other = np.array([5, 1, 4, 0, 0, 0, 0, 1, 0, 0, 0.0]), np.array([0, 0, 0, 2, 2, 90, 50, 5, 3, 2, 9.0])
    w, bias = X.machine(f, toxic, other)
    model = X.Model(land.table.codes, land.rows @ (land.root @ w), bias)
    got = X.Scorer(model).margins(*X.packed(WORDS))
    assert got == pytest.approx(np.maximum(f @ w + bias, 0)) and got[0] > 0 and got[1] > 0 and got[5] == 0
    # the loss has no lower neighbour
    loss = lambda w, b: (toxic * np.maximum(0, 1 - f @ w - b) ** 2 + other * np.maximum(0, 1 + f @ w + b) ** 2).sum() + (w * w).sum()
    rng = np.random.default_rng(1)
    assert all(loss(w, bias) <= loss(w + 1e-3 * rng.normal(size=len(w)), bias + 1e-3 * rng.normal()) + 1e-9 for _ in range(20))


def test_strings():
    texts = ["you Are st-up.id! i d i o t x.\nnew line 42", "", "a " + "b" * 70, "é à ü"]
    raw = [t.lower().encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    row, sentence, number, (text, edge, h) = X.strings(np.frombuffer(b"".join(raw), np.uint8), offs, C.Rolling(12))
    names = [text[a:b].tobytes().decode() for a, b in zip(edge, edge[1:])]
    got = [[names[i] for i in number[row == r]] for r in range(4)]
    assert sorted(got[0]) == sorted(["you", "are", "stupid", "idiotx", "new", "line"]) and got[1] == []
    assert sorted(got[2]) == ["a", "b" * 22, "b" * 32, "b" * 32, "b" * 32]
    assert got[3] == ["éàü"]
    by = {names[i]: s for i, s in zip(number[row == 0], sentence[row == 0])}
    assert by["you"] == by["stupid"] < by["idiotx"] < by["new"] == by["line"]


@pytest.fixture(scope="module")
def large(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, X.train(docs, labels)


def test_held_out_accuracy(spark, large):
    docs, labels, model = large
    out = X.classify(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out]
    for lang in ("en", "de", "fr", "es"):
        good, bad = ([r for r in held if r.lang == lang and r.toxic == y] for y in (0, 1))
        assert sum(r.predicted for r in good) <= 0.02 * len(good)
        assert sum(r.predicted for r in bad) >= 0.85 * len(bad)


def test_insults_with_gaps_and_inserted_characters(spark, large):
    """The same clean texts, with plain, split, dotted and padded insults."""
    docs, labels, model = large
    clean = labels.where("toxic = 0 AND quality = 1").join(docs.where("lang = 'en'"), "doc_id").orderBy("doc_id").limit(40).collect()
    forms = ["stupid idiot", "s t u p i d i d i o t", "s.t.u.p.i.d i-d-i-o-t", "stuupid idiiot", "STUPIDS idiots", "stupxid idioxt"]
    rows = [(100 * k + i, " ".join(" ".join([w, form, "pathetic"]) if j in (3, 20, 40) else w for j, w in enumerate(r.text.split(" "))), k)
            for k, form in enumerate(forms) for i, r in enumerate(clean) if len(r.text) < 3000]
    df = spark.createDataFrame(rows, "doc_id long, text string, form int")
    out = X.classify(df, model).join(df, "doc_id").collect()
    for k in range(len(forms)):
        own = [r.predicted for r in out if r.form == k]
        assert len(own) > 10 and sum(own) >= 0.9 * len(own), forms[k]
    plain = spark.createDataFrame([(r.doc_id, r.text) for r in clean], "doc_id long, text string")
    assert sum(r.predicted for r in X.classify(plain, model).collect()) == 0


def test_messy(spark, messy, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (8, 0, 0), (None, 1, 0), (9, None, None), (10, 1, 0), (13, 0, 0), (77, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    out = X.classify(messy, X.train(messy, labels)).collect()
    assert len(out) == messy.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in X.classify(messy, X.train(messy, labels.limit(0))).collect()} == {0.5}
    assert X.classify(nothing, X.train(nothing, labels)).collect() == []
    twice = spark.createDataFrame([(i, "you awful foolish person. " * 3 if i % 2 else "a quiet text about nothing. " * 3) for i in range(60)], "doc_id long, text string")
    marked = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    model = X.train(twice, marked)
    assert [r.predicted for r in X.classify(twice, model).orderBy("doc_id").collect()] == [i % 2 for i in range(60)]
