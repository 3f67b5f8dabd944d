import hashlib
import re

from tessera.llm import substring_dedup as X

from .conftest import word_text


def brute(rows, window=50):
    """(n_words, n_removed, sha) of each (doc_id, text), in order."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [X.LAST if d is None else d for d, _ in rows]
    first = {}
    for d, w in zip(ids, words):
        for i in range(len(w) - window + 1):
            k = hash(tuple(w[i:i + window]))
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in zip(ids, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[hash(tuple(w[i:i + window]))] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted((str(d), *x) for (d, _), x in zip(rows, brute(rows)))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in X.substring_dedup(docs).collect())
    assert got == want
    return got


def test_cover():
    assert X.is_cover(X.COVER, X.PERIOD) and not X.is_cover((0, 1, 3), 31)


def test_messy(messy, nothing):
    assert sum(r[2] for r in check(messy)) > 0
    assert X.substring_dedup(nothing).collect() == []


def test_every_alignment(spark):
    """A passage of exactly 50 words (found) or 49 words (not) at all offsets."""
    p50, p49 = word_text(11, 50), word_text(12, 49)
    rows = [(0, p50 + " " + word_text(13, 40) + " " + p49)]
    rows += [(i + 1, f"{word_text(100 + i, i)} {p50} {word_text(200 + i, i % 7 + 1)} {p49} end{i}") for i in range(40)]
    got = check(X.C.store(spark.createDataFrame(rows, "doc_id long, text string"), "aligned"))
    assert sum(r[2] for r in got) == 40 * 50


def test_brute_force_on_documents(spark, sf):
    assert sum(r[2] for r in check(spark.read.parquet(f"{sf}/documents.parquet"))) > 0
