import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as VF
from tessera.operators import cluster as CL
from tessera.operators import graph as G
from tessera.operators import near as N
from tessera.operators import reduce as R


def test_cosine_reference_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])],
                               "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    got = [r[0] for r in df.select(VF.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, -1.0, 0.0]


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "id LONG")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4),      # path
                                   (5, 6), (6, 7), (7, 5),      # cycle
                                   ], "a LONG, b LONG")         # 8, 9 isolated
    got = {r["id"]: r["comp"] for r in G.connected_components(nodes, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9}


def greedy(order, edges):
    adj = {n: set() for n in order}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    grouped, out = set(), {}
    for i, n in enumerate(order):
        if n in grouped:
            continue
        out[n] = n
        for m in order[i + 1:]:
            if m not in grouped and m in adj[n]:
                out[m] = n
                grouped.add(m)
    return out


def test_leader_groups_not_transitive(spark):
    nodes = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "id STRING, rank INT")
    edges = spark.createDataFrame([("A", "B"), ("B", "C")], "a STRING, b STRING")
    got = {r["id"]: r["leader"] for r in G.leader_groups(nodes, edges).collect()}
    assert got == {"A": "A", "B": "A", "C": "C"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leader_groups_equal_sequential_greedy(spark, seed):
    rnd = random.Random(seed)
    n = 24
    order = list(range(n))
    rnd.shuffle(order)
    edges = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(70)}
    nodes = spark.createDataFrame([(v, i) for i, v in enumerate(order)], "id LONG, rank INT")
    e = spark.createDataFrame(sorted(edges), "a LONG, b LONG")
    got = {r["id"]: r["leader"] for r in G.leader_groups(nodes, e).collect()}
    assert got == greedy(order, edges)


def brute_dbscan(pts, eps, min_samples):
    n = len(pts)
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= min_samples
    comp = -np.ones(n, dtype=int)
    for i in range(n):
        if core[i] and comp[i] < 0:
            stack, comp[i] = [i], i
            while stack:
                j = stack.pop()
                for k in np.where(nb[j] & core)[0]:
                    if comp[k] < 0:
                        comp[k] = i
                        stack.append(k)
    reps = sorted(set(comp[core]))
    num = {r: c for c, r in enumerate(reps)}
    out = []
    for i in range(n):
        if core[i]:
            out.append(num[comp[i]])
        else:
            cs = [num[comp[k]] for k in np.where(nb[i] & core)[0]]
            out.append(min(cs) if cs else -1)
    return out


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(7)
    blobs = [rng.normal(c, 0.15, size=(m, 2)) for c, m in (((0, 0), 20), ((3, 3), 18), ((0, 4), 16), ((5, 0), 14))]
    bridge = np.array([[1.5, 1.5], [2.0, 2.0]])
    noise = np.array([[10.0, 10.0], [-8.0, 5.0]])
    dup = np.repeat(np.array([[3.0, 3.0]]), 3, axis=0)
    pts = np.vstack(blobs + [bridge, noise, dup])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id LONG, v ARRAY<DOUBLE>")
    for eps in (0.3, 0.6):
        got = {r["id"]: r["cluster"] for r in CL.dbscan(df, "id", "v", eps=eps, min_samples=15,
                                                          metric="euclidean", grid_dims=2).collect()}
        assert [got[i] for i in range(len(pts))] == brute_dbscan(pts, eps, 15)
        shuffled = df.repartition(3).orderBy(F.rand(1))
        again = {r["id"]: r["cluster"] for r in CL.dbscan(shuffled, "id", "v", eps=eps, min_samples=15,
                                                            metric="euclidean", grid_dims=2).collect()}
        assert again == got


def test_unknown_methods_raise():
    with pytest.raises(ValueError):
        CL.check_method("SPECTRAL")
    from tessera.plans import build as B
    with pytest.raises(ValueError):
        B._check(B.Params(reducer="ISOMAP"))


def test_reduction_shapes(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(x) for x in rng.random(10)]) for i in range(100)], "id LONG, v ARRAY<DOUBLE>")
    red5, _ = R.reduce_pca(df, "id", "v", 5)
    red3, _ = R.reduce_pca(df, "id", "v", 3)
    assert red5.count() == 100 and {len(r["r"]) for r in red5.collect()} == {5}
    assert {len(r["r"]) for r in red3.collect()} == {3}
    km = CL.kmeans(df, "id", "v", k=10)
    assert km.count() == 100 and km.select("cluster").distinct().count() <= 10


def test_pairs_equal_brute_force(spark, monkeypatch):
    """Small blocks, repeated vectors, a zero vector, text ids; and few pairs are looked at in full."""
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 64))
    pts = np.concatenate([centres[rng.integers(0, 12, 150)] * [1.0 / (1 + k // 8) for k in range(64)] + rng.normal(0, 0.25, (150, 64)) / np.arange(1, 65), np.zeros((1, 64))])
    pts[40:44] = pts[40]
    df = spark.createDataFrame([(f"k{i:03d}", [float(x) for x in p]) for i, p in enumerate(pts)], "id STRING, v ARRAY<DOUBLE>").repartition(3)
    unit = pts / np.maximum(np.linalg.norm(pts, axis=1), 1e-300)[:, None]
    cos = unit @ unit.T
    brute = {(f"k{i:03d}", f"k{j:03d}"): cos[i, j] for i in range(151) for j in range(i + 1, 151) if cos[i, j] >= 0.85}
    got = {(r.a, r.b): r.cosine for r in G.cosine_pairs(df, "id", "v", 0.85).collect()}
    assert got.keys() == brute.keys() and len(got) > 50
    assert all(abs(got[k] - brute[k]) < 1e-9 for k in got)
    assert G.candidate_share(df, "id", "v", 0.85) < 0.3
    with pytest.raises(ValueError):
        G.cosine_pairs(df, "id", "v", 0.0)


def test_nearest_equals_brute_force(spark):
    """Ties go to the smaller id; beyond the largest radius nothing is found; a dense cell."""
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(0, 0.05, (400, 3)), rng.uniform(-4, 4, (40, 3)), [[2, 2, 2]], [[2, 2, 4]]])
    new = np.concatenate([rng.normal(0, 0.3, (60, 3)), rng.uniform(-9, 9, (30, 3)), [[2, 2, 3]]])
    frame = lambda v: spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(v)], "pid LONG, v ARRAY<DOUBLE>")
    d = N.distances(new, pts)
    radius, _ = N.first_radius(frame(pts), 3)
    for most in (None, 1.0):
        got = {r.pid: r.near for r in N.nearest(frame(new), frame(pts), 3, radius, 40.0, most).collect()}
        assert got == {i: int(d[i].argmin()) for i in range(len(new)) if most is None or d[i].min() <= most}


@pytest.mark.parametrize("n", [17, 1000])
def test_components_of_a_zigzag_path(spark, n):
    """0, n-1, 1, n-2, …: a path on which labels walk one hop a round would need n rounds."""
    order = [i // 2 if i % 2 == 0 else n - 1 - i // 2 for i in range(n)]
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    nodes = spark.range(n + 1)
    for per_task in (G.LINKS, 5):
        got = {r["id"]: r["comp"] for r in G.connected_components(nodes, edges, per_task=per_task).collect()}
        assert got == {i: 0 for i in range(n)} | {n: n}


@pytest.mark.parametrize("block", [100, G.RANKS])
def test_leaders_of_a_long_chain(spark, monkeypatch, capsys, block):
    """Rounds follow the blocks that the chain passes, not its nodes."""
    rounds, walked = [], G.stored

    def counted(df, name="table"):
        rounds.append(name)
        return walked(df, name)
    monkeypatch.setattr(G, "stored", counted)
    n = 1000
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    nodes = spark.range(n).selectExpr("id", "id AS rank")
    got = {r["id"]: r["leader"] for r in G.leader_groups(nodes, edges, block=block).collect()}
    assert got == {i: i - i % 2 for i in range(n)}
    print("rounds:", rounds.count("state"))
    assert rounds.count("state") <= -(-n // block)


def test_blocks_are_moved_by_tile_and_not_by_pair(spark, monkeypatch):
    """All 24 blocks meet, 300 pairs, in tiles of three groups; before, each pair moved two blocks."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    pts = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "pid LONG, v ARRAY<DOUBLE>").cache()
    monkeypatch.setattr(N, "GROUPS", 3)
    monkeypatch.setattr(N, "GROUP_POINTS", 50)
    monkeypatch.setattr(N, "ROWS_AT_ONCE", 7)
    table = N.blocks(pts, 100.0, 3, ["pid"], block=17)
    made = {}
    stored, within = N.stored, N.within
    monkeypatch.setattr(N, "stored", lambda df, name="table": made.setdefault(name, stored(df, name)))

    def near(a, va, b, vb, same):
        i, j, d = within(va, vb, 1.0)
        ok = a[0][i] < b[0][j] if same else np.ones(len(i), dtype=bool)
        return np.minimum(a[0][i], b[0][j])[ok], np.maximum(a[0][i], b[0][j])[ok], d[ok]
    got = N.met(N.block_pairs(table, table, 3, symmetric=True), table, table, ["pid"], ["pid"], 3, near, "a long, b long, d double", "near")
    d = N.distances(x, x)
    want = {(i, j): d[i, j] for i in range(400) for j in range(i + 1, 400) if d[i, j] <= 1.0}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.a, r.b): r.d for r in rows} == want
    n, tiles = table.count(), made["tiled"]
    moved = tiles.select("tile", "l").distinct().count() + tiles.select("tile", "r").distinct().count()
    assert tiles.count() == n * (n + 1) // 2 and moved <= 4 * n
    # nothing meets nothing
    none = table.where("false")
    made.clear()
    assert N.met(N.block_pairs(none, table, 3), none, table, ["pid"], ["pid"], 3, near, "a long, b long, d double", "near").collect() == []


def test_distances_at_the_radius_do_not_depend_on_products():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8)) * 100
    y = np.concatenate([x + np.eye(8)[rng.integers(0, 8, 60)] * 0.5, rng.normal(size=(9, 8))])
    d = N.distances(x, y)
    for radius in (0.5, float(d[3, 3]), float(np.nextafter(d[3, 3], 0)), float(d[0, 7]), 0.0):
        assert (N.are_within(x, y, radius) == (d <= radius)).all()
        i, j, w = N.within(x, y, radius)
        assert set(zip(i, j)) == set(zip(*np.nonzero(d <= radius))) and (w == d[i, j]).all()
    empty = np.zeros((0, 8))
    assert N.are_within(empty, y, 1.0).shape == (0, 69) and not len(N.within(empty, y, 1.0)[0])


def test_dbscan_and_nearest_in_small_blocks_equal_plain_versions(spark, monkeypatch):
    """A tile knows which points are core, joined or near already, and looks at no pair for them."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(150, 4)) * 0.4, rng.normal(size=(60, 4)) * 0.4 + 3, rng.uniform(-2, 5, size=(60, 4))]).round(1)
    d = N.distances(v, v)
    near = d <= 0.6
    core = near.sum(axis=1) >= 6
    label = np.arange(len(v))
    while True:
        new = np.array([label[near[k] & core].min() if core[k] else label[k] for k in range(len(v))])
        if (new == label).all():
            break
        label = new
    heads = sorted({int(label[k]) for k in range(len(v)) if core[k]})
    want = [heads.index(label[k]) if core[k] else min((heads.index(label[x]) for x in np.flatnonzero(near[k] & core)), default=-1) for k in range(len(v))]
    blocks = N.blocks
    monkeypatch.setattr(N, "blocks", lambda pts, side, dims, fields, comp=None: blocks(pts, side, dims, fields, comp, 16))
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())], "key long, v array<double>").repartition(3)
    got = {r.key: r.cluster for r in CL.dbscan(df, "key", "v", eps=0.6, min_samples=6, metric="euclidean").collect()}
    assert [got[k] for k in range(len(v))] == want and len(heads) >= 2 and -1 in want
    # links by components: a pair of blocks in one component is not looked at
    task = CL._Joined()
    x, y = np.arange(100), np.arange(100, 200)
    vx, vy = rng.normal(size=(100, 4)), rng.normal(size=(100, 4))
    a, b = CL._links(x, vx, y, vy, 9.0, task)
    assert len(a) == 199 and CL._links(x, vx, y, vy, 9.0, task) is None
    # the nearest, ties by the smaller id, radii left out in between
    asked = rng.uniform(-2, 5, size=(80, 4)).round(1)
    far = N.distances(asked, v)
    pts = spark.createDataFrame([(len(v) - 1 - k, x) for k, x in enumerate(v.tolist())], "pid long, v array<double>")
    new = spark.createDataFrame([(k, x) for k, x in enumerate(asked.tolist())], "pid long, v array<double>")
    found = {r.pid: (r.d, r.near) for r in N.nearest(new, pts, 3, 0.01, 20.0).collect()}
    assert found == {k: min((far[k, x], len(v) - 1 - x) for x in range(len(v))) for k in range(len(asked))}


def test_cosine_pairs_carry_their_ids(spark):
    """Whole numbers are not joined to the pairs; other ids are. Null and repeated ids make no pair of their own."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5))
    ids = [None if k % 20 == 0 else k // 2 for k in range(60)]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = sorted((min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(60) for j in range(i) if ids[i] is not None and ids[j] is not None
                  and ids[i] != ids[j] and unit[i] @ unit[j] >= 0.5)
    df = spark.createDataFrame(list(zip(ids, v.tolist())), "id long, v array<double>")
    assert sorted((r.a, r.b) for r in G.cosine_pairs(df, "id", "v", 0.5).collect()) == want
    text = df.selectExpr("lpad(id, 2, '0') AS id", "v")
    assert sorted((int(r.a), int(r.b)) for r in G.cosine_pairs(text, "id", "v", 0.5).collect()) == want
    assert "Join" not in G.cosine_pairs(df, "id", "v", 0.5)._jdf.queryExecution().toString()
