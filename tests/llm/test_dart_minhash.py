import random

import numpy as np

from tessera.llm import common as C
from tessera.llm import dart_minhash as X
from tessera.llm import stages

from .conftest import word_text


def shingle_set(t):
    w = (t or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """Class of each row (as the smallest row number), by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    by = {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            by.setdefault(x, []).append(i)
    seen = {(i, j) for m in by.values() for i in m for j in m if i < j}
    for i, j in seen:
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def check(docs):
    rows = [(r.doc_id, r.text) for r in C.identified_text(docs).orderBy("_row").collect()]
    got = X.near_dedup(docs).collect()
    assert len(got) == len(rows)
    by_row = sorted(got, key=lambda r: r._row)
    want = brute(rows)
    groups = {}
    for i, c in enumerate(want):
        groups.setdefault(c, []).append(i)
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        assert {by_row[i].class_id for i in members} == {min(ids) if ids else None}
        assert {by_row[i].class_size for i in members} == {len(members)}
        assert sum(by_row[i].kept for i in members) == 1
    return got


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    n, k = 60, 6000
    e = C.mix(np.arange(n, dtype=np.uint64))
    x, y = rng.integers(1, 9, n) * 0.7, rng.integers(1, 9, n) * 0.7
    x[:20] = y[:20]
    sig = X.signatures(np.repeat([0, 1], n), np.concatenate([e, e]), np.concatenate([x, y]), 2, k)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    alone = X.signatures(np.zeros(n, int), e, x, 1, k)  # other rows of the slice don't matter
    assert (alone[0] == sig[0]).all()


def test_messy(spark, messy, nothing):
    check(messy)
    assert X.near_dedup(nothing).collect() == []
    kept = stages.near(spark, messy, "")
    assert kept.columns == messy.columns and kept.count() == sum(r.kept for r in X.near_dedup(messy).collect())


def test_brute_force_on_documents(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_chains_and_hubs(spark):
    """Variants of one text that are similar to it but not to one another, a chain
    of small edits, and texts that share a long passage without being similar."""
    rng = random.Random(5)
    rows, base = [], word_text(7, 400).split()
    rows.append((0, " ".join(base)))
    for i in range(60):
        w = base[:]
        for at in rng.sample(range(400), 8):
            w[at] = f"v{i}x{at}"
        rows.append((len(rows), " ".join(w)))
    chain = word_text(8, 300).split()
    for i in range(30):
        chain[(i * 37) % 300] = f"c{i}"
        chain[(i * 37 + 150) % 300] = f"d{i}"
        rows.append((len(rows), " ".join(chain)))
    passage = word_text(9, 140)
    for i in range(80):
        rows.append((len(rows), passage + " " + word_text(1000 + i, 100)))
    rng.shuffle(rows)
    got = check(C.store(spark.createDataFrame(rows, "doc_id long, text string"), "hubs"))
    assert len({r.class_id for r in got}) == 2 + 80


def test_repeated_shingles(spark):
    """Texts against themselves several times over, and against copies with one line
    repeated often: similar as sets, not by occurrences."""
    rows = []
    for i in range(40):
        base = word_text(3000 + i, 204)
        line = word_text(4000 + i, 20)
        rows.append((len(rows), base))
        rows.append((len(rows), " ".join([base] * (2, 4, 8)[i % 3]) if i % 4 else base + (" " + line) * 1000))
    got = check(C.store(spark.createDataFrame(rows, "doc_id long, text string"), "repeated"))
    assert len({r.class_id for r in got}) == 40


def variants(n, words, edits, seed):
    """Texts similar to a base that isn't among them, and not to one another."""
    rng = random.Random(seed)
    base = word_text(seed, words).split()
    rows = []
    for i in range(n):
        w = base[:]
        for at in rng.sample(range(words), edits):
            w[at] = f"v{i}x{at}"
        rows.append((i, " ".join(w)))
    return rows + [(n, rows[0][1] + " more"), (n + 1, rows[1][1] + " more")]


def test_near_threshold_group_is_not_split_by_shingles(spark, monkeypatch):
    """Before, such a group went through round after round of keys by shingle."""
    stored, store = [], C.store
    monkeypatch.setattr(C, "store", lambda df, name="table": (stored.append(name), store(df, name))[1])
    rows = C.numbered_once(spark.createDataFrame(variants(120, 300, 12, 21), "doc_id long, text string"))
    got = X.near_rows(rows).collect()
    assert len({r.class_id for r in got}) == 120
    assert "lacking" not in stored and "linked" in stored


def test_large_keys_by_first_shingles(spark, monkeypatch):
    """With bounds so low that keys are large ones: first shingles, then blocks."""
    stored, store = [], C.store
    monkeypatch.setattr(C, "store", lambda df, name="table": (stored.append(name), store(df, name))[1])
    monkeypatch.setattr(X, "FEW", 2)
    monkeypatch.setattr(X, "MANY", 8)
    rows = variants(40, 300, 12, 22)
    passage = word_text(23, 140)
    rows += [(100 + i, passage + " " + word_text(2000 + i, 100)) for i in range(40)]
    rows += [(200 + i, passage + " " + word_text(2000 + i, 100) + " end") for i in range(10)]
    got = check(C.store(spark.createDataFrame(rows, "doc_id long, text string"), "large_keys"))
    assert len({r.class_id for r in got}) == 80 and {"prefixes", "blocks"} <= set(stored)


def test_sketches_pass_similar_pairs():
    least = X.least_agreeing(150, 0.8)
    rng = np.random.default_rng(5)
    assert 80 < least < 100 and X.least_agreeing(5, 0.1) == 0
    assert (rng.binomial(150, 0.8, 1_000_000) >= least).all()
