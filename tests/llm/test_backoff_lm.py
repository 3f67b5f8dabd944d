import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tessera.llm import backoff_lm as X
from tessera.llm import common as C


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0


def brute(rows, order, mu=X.MU):
    """Walk the automaton token by token, along failure arcs."""
    count = [Counter() for _ in range(order + 1)]
    for d, t in rows:
        seq = ["<s>", *tokens(t)]
        if not held(d):
            for i in range(len(seq)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        count[n][tuple(seq[i - n + 1:i + 1])] += 1
    del count[1][("<s>",)]
    starts = sum(not held(d) for d, _ in rows)
    n, v = sum(count[1].values()), len(count[1])

    def followers(state):
        return starts if state == ("<s>",) else count[len(state)][state]

    def weight(state, w):
        if not state:
            return math.log10((count[1][(w,)] + 0.1) / (n + 0.1 * (v + 1)))
        if count[len(state) + 1][(*state, w)]:
            return math.log10((count[len(state) + 1][(*state, w)] + mu * 10 ** weight(state[1:], w)) / (followers(state) + mu))
        return math.log10(mu / (followers(state) + mu)) + weight(state[1:], w)
    out = []
    for d, t in rows:
        state, total, base, known = ("<s>",)[:order - 1], 0.0, 0.0, 0
        for w in tokens(t):
            total += weight(state, w)
            base += weight((), w)
            known += count[1][(w,)] > 0
            state = (*state, w)[max(0, len(state) + 2 - order):]
        out.append((str(d), held(d), len(tokens(t)), known, n, base, total))
    return sorted(out)


def check(docs, order):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in X.score(docs, order).collect())
    want = brute(rows, order)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_messy(messy, order):
    check(messy, order)


def test_documents(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), 2)


def test_edges(spark, nothing, monkeypatch):
    assert X.score(nothing).collect() == []
    only_held = C.store(spark.createDataFrame([(i, "a b") for i in range(200) if held(i)], "doc_id long, text string"), "held")
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in X.score(only_held).collect())


def test_better_than_the_base_on_held_out_texts(spark):
    out = X.score(C.table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert out.s > out.b


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cols = "doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score"
    want = con.execute(f"SELECT {cols} FROM ({X.ORACLE}) ORDER BY doc_id").fetchall()
    assert sorted(map(tuple, X.op8_backoff_lm(spark, sf).collect())) == want
