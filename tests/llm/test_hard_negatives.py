import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block string, rank int"


def brute(rows, is_anchor, low=80, high=100, n=5):
    """rows: {id: (label, vector)}."""
    out = []
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))  # noqa: E731  shorter vectors are filled up with zeros
    for a, (label, v) in rows.items():
        if not is_anchor(a):
            continue
        scored = sorted(((-dot(v, w), i, other) for i, (other, w) in rows.items() if i != a))
        for ps, p, _ in [x for x in scored if x[2] == label][:n]:
            fits = [x for x in scored if x[2] != label and low * -ps <= 100 * -x[0] <= high * -ps][:n]
            out += [(a, p, k + 1, i, -ps, -ns) for k, (ns, i, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("reach", [1, 300, 1 << 20, 1 << 40])
def test_packed_products_are_exact(reach):
    """Also where a field is wider than a double, and where scores pass 64 bits."""
    rng = random.Random(reach)
    c = np.array([[rng.randint(-reach, reach) for _ in range(64)] for _ in range(37)])
    a = np.array([[rng.randint(-reach, reach) for _ in range(64)] for _ in range(5)])
    c[3], a[1], c[4], a[2] = reach, reach, -reach, -reach
    p = H.Packed(c, reach)
    assert p.fields == {1: 5, 300: 2, 1 << 20: 1, 1 << 40: 4}[reach] and (p.wide is object) == (reach == 1 << 40)
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in c] for u in a]
    assert p.scores(a).tolist() == want
    assert H.Packed(np.zeros((3, 0), np.int64), 0).scores(np.zeros((2, 0), np.int64)).tolist() == [[0] * 3] * 2


def test_small_blocks_equal_brute_force(spark):
    """Many blocks and chunks, ties, a vector that a third of all rows share."""
    rng = random.Random(5)
    rows = {}
    for i in range(600):
        v = [1.0, 0.5, -0.25, 0.0] if i % 3 == 0 else [rng.choice((-1.0, -0.5, 0.1, 0.5, 1.0)) for _ in range(4)]
        rows[i] = (rng.randint(0, 3), v)
    df = H.clean(spark.createDataFrame([(i, v, label, None, None, 1) for i, (label, v) in rows.items()], SCHEMA))
    got = H.hard_negatives(df, F.col("vec_id") % 20 == 0, block=40, chunk=7)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    whole = {i: (label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, (label, v) in rows.items()}
    want = brute(whole, lambda i: i % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_messy(spark):
    """Nulls, values that aren't finite, repeated ids, short and empty vectors, too few
    rows of a label, an empty table."""
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.9, 0.9], 2), (2, [9.0, 9.0], 3), (3, [0.8], 2), (4, [], 2),
            (5, None, 1), (6, [1.0, None], 1), (7, [inf, 1.0], 2), (8, [nan, 1.0], 2), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (10, [1.0, 1.0], 7), (20, [-1.0, -1.0], 1)]
    df = spark.createDataFrame([(i, v, label, "x", "y", 3) for i, v, label in rows], SCHEMA)
    kept = {r.vec_id: (r.label, r.v) for r in H.clean(df).collect()}
    assert sorted(kept) == [0, 1, 2, 3, 4, 10, 20] and kept[2] == (2, [230, 230]) and kept[4] == (2, [])
    got = sorted(tuple(r) for r in H.hard_negatives(H.clean(df), F.col("vec_id") % 10 == 0).collect())
    assert got == brute(kept, lambda i: i % 10 == 0) and got
    assert H.hard_negatives(H.clean(df.limit(0)), F.col("vec_id") % 10 == 0).collect() == []
    assert H.hard_negatives(H.clean(df), F.lit(False)).collect() == []


def test_wide_vectors(spark):
    """Components beyond what a double's fields hold."""
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1e6, 1e6) for _ in range(5)], i % 2) for i in range(60)]
    df = H.clean(spark.createDataFrame([(i, v, label, None, None, 0) for i, v, label in rows], SCHEMA))
    kept = {r.vec_id: (r.label, r.v) for r in df.collect()}
    assert sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 10 == 0, block=16).collect()) == brute(kept, lambda i: i % 10 == 0)


def test_no_pair_is_a_row(spark, sf):
    """The only joins and explosions are Python maps over blocks."""
    plan = H.op13_hard_negatives(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Generate" not in plan
