import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import repetition as R


def brute(text, min_repeat=R.MIN_REPEAT):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    length = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            length[i], length[j] = max(length[i], k), max(length[j], k)
    grams = Counter(tuple(w[i:i + 3]) for i in range(n - 2))
    rep = {i + k for i in range(n - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    cov = {i + k for i in range(n) if length[i] >= min_repeat for k in range(length[i])}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    longest = max(length, default=0)
    failed = n < 50 or 100 * len(rep) > 50 * n
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(rep), "n_covered": len(cov), "longest_repeat": longest,
            "base_failed": failed, "kept": not failed and len(cov) <= R.MAX_COVERED * n and longest <= R.MAX_LONGEST}


def check(docs, limit):
    got = {}
    for r in R.repetition_rules(docs).collect():
        got.setdefault(r.doc_id, []).append(r.asDict())
    for r in docs.collect():
        if r.text is None or len(r.text.split()) <= limit:
            want = brute(r.text) | {"doc_id": r.doc_id}
            assert want in got[r.doc_id], (r.text, want, got[r.doc_id])
    assert sum(map(len, got.values())) == docs.count()


def test_messy(messy, nothing):
    check(messy, 2000)
    assert R.repetition_rules(nothing).collect() == []


def test_brute_force_on_documents(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), 400)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4))
def test_repeat_lengths(rows):
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    ids = np.array([x for r in rows for x in r], dtype=np.int64)
    got = R.repeat_lengths(ids, offs).tolist()
    want = []
    for r in rows:
        for i in range(len(r)):
            best = 0
            for j in range(len(r)):
                k = 0
                while i != j and max(i, j) + k < len(r) and r[i + k] == r[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
    assert got == want


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    rows = (R.op9_repetition(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 AND NOT base_failed").collect())
    assert rows and sum(r.kept for r in rows) >= 0.99 * len(rows)
