"""The density hierarchy and DBSCAN against plain versions that look at all pairs."""

import random

import numpy as np
import pytest

from tessera.operators import density as D
from tessera.operators import near as N


def plain_density(rows, m=15, eps_max=None):
    """{key: cluster}, from all pairs and sequential merges, links of one weight at once."""
    keys = sorted(rows)
    v = np.array([rows[k] for k in keys], dtype=float)
    d = N.distances(v, v)
    core = np.sort(d, axis=1)[:, m - 1] if len(keys) >= m else np.full(len(keys), np.inf)
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    most = np.inf if eps_max is None else eps_max
    i, j = np.triu_indices(len(keys), 1)
    order = [x for x in np.argsort(w[i, j], kind="stable") if w[i, j][x] <= most]
    weights = sorted({w[i[x], j[x]] for x in order})
    least = next((x for x in weights if x > 0), 1.0)
    rate = lambda e: 1 / max(e, least)
    comp = {p: frozenset([p]) for p in range(len(keys))}
    node = {}  # component -> its cluster, once it has m points
    clusters = []
    at = 0

    def new(points, level):
        clusters.append({"points": points, "mass": 0.0, "n": 0, "up": None, "start": None, "kids": []})
        return clusters[-1]
    same = {}
    for p in range(len(keys)):
        same.setdefault(tuple(v[p]), []).append(p)
    groups = [frozenset(g) for g in same.values()]
    for g in groups:
        for p in g:
            comp[p] = g
        if len(g) >= m:
            node[g] = new(g, 0)
            node[g]["mass"], node[g]["n"] = len(g) / least, len(g)
    for level in weights:
        joined = []
        while at < len(order) and w[i[order[at]], j[order[at]]] == level:
            joined.append((i[order[at]], j[order[at]]))
            at += 1
        before, parent = dict(comp), {}
        for a, b in joined:
            if comp[a] != comp[b]:
                both = comp[a] | comp[b]
                for p in both:
                    comp[p] = both
        for p in range(len(keys)):
            if comp[p] != before[p]:
                parent.setdefault(comp[p], set()).add(before[p])
        for g, kids in parent.items():
            if len(g) < m:
                continue
            big = [k for k in kids if k in node]
            if len(big) == 1:
                c = node[g] = node[big[0]]
                gone = len(g) - len(big[0])
                c["mass"], c["n"], c["points"] = c["mass"] + gone * rate(level), c["n"] + gone, g
            else:
                c = node[g] = new(g, level)
                c["mass"], c["n"] = len(g) * rate(level), len(g)
                for k in big:
                    node[k]["up"], node[k]["start"] = c, rate(level)
                    c["kids"].append(node[k])
    roots = [c for c in clusters if c["up"] is None]
    top = eps_max if eps_max is not None else None
    return keys, clusters, roots, top, least


def plain_labels(rows, m=15, eps_max=None, top=None):
    keys, clusters, roots, _, least = plain_density(rows, m, eps_max)
    barred = roots[0] if len(roots) == 1 else None

    def best(c):
        below = [best(k) for k in c["kids"]]
        total = sum(x[0] for x in below)
        start = c["start"] if c["start"] is not None else 1 / max(top, least)
        own = c["mass"] - c["n"] * start
        if c is not barred and own >= total:
            return own, [c]
        return total, [x for b in below for x in b[1]]
    taken = [c for r in roots for c in best(r)[1]]
    groups = sorted((min(keys[p] for p in c["points"]), c["points"]) for c in taken)
    out = {k: -1 for k in keys}
    for n, (_, g) in enumerate(groups):
        out.update((keys[p], n) for p in g)
    return out


def blob(rng, n, centre, spread):
    return [[rng.gauss(c, spread) for c in centre] for _ in range(n)]


def case(name):
    rng = random.Random(name)
    if name == "blobs":
        pts = blob(rng, 40, (0, 0), 0.1) + blob(rng, 30, (1.2, 0), 0.25) + blob(rng, 20, (5, 5), 0.05) + blob(rng, 14, (9, 9), 0.05) + [[rng.uniform(-3, 12), rng.uniform(-3, 12)] for _ in range(25)]
    elif name == "nested":
        pts = blob(rng, 25, (0, 0, 0), 0.05) + blob(rng, 25, (0.5, 0, 0), 0.05) + blob(rng, 60, (0.2, 0, 0), 0.6) + blob(rng, 30, (6, 0, 0), 0.3)
    elif name == "copies":
        pts = [[1.0, 2.0]] * 40 + [[1.5, 2.0]] * 9 + blob(rng, 30, (4, 4), 0.2) + blob(rng, 20, (1, 2), 0.3)
    else:
        pts = blob(rng, 50, (0,) * 5, 0.3) + blob(rng, 50, (2,) + (0,) * 4, 0.3) + blob(rng, 20, (0, 3, 0, 0, 0), 1.0)
    return {k: p for k, p in enumerate(pts)}


@pytest.mark.parametrize("name", ["blobs", "nested", "copies", "five"])
def test_density_equals_plain_version(spark, name):
    """A full ladder gives the tree of all pairs."""
    rows = case(name)
    df = spark.createDataFrame(list(rows.items()), "key long, vec array<double>").repartition(3)
    got = {r.key: r.cluster for r in D.density(df, "key", "vec", levels=None).collect()}
    pts, _ = N.points(df, "key", "vec")
    radius, extent = N.first_radius(pts, min(N.GRID, len(rows[0])))
    _, radii = N.core_distances(pts, 15, min(N.GRID, len(rows[0])), radius, extent)
    want = plain_labels(rows, eps_max=radii[-1], top=radii[-1])
    assert got == want and max(want.values()) >= 1 and (name in ("copies", "five") or -1 in want.values())


def test_ladder_is_exact_percentiles_of_a_sorted_table(spark):
    """As ``F.percentile`` has them, which holds all weights in one task."""
    from pyspark.sql import functions as F
    rng = random.Random(5)
    for n in (1, 2, 7, 500):
        edges = spark.createDataFrame([(i, i + 1, rng.choice([0.5, rng.random()])) for i in range(n)], "a long, b long, w double").repartition(4)
        at = edges.agg(F.percentile("w", F.array(*[F.lit((i + 1) / 32) for i in range(32)]))).first()[0]
        assert D.ladder(edges, 32) == sorted(set(at))
    assert D.ladder(edges.where("w > 2"), 32) == []


def test_forest_holds_the_least_links():
    """As many and as light as Kruskal's, also where a component is at either end of links."""
    for seed in range(20):
        rng = np.random.default_rng(seed)
        a, b, w = rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.random(300).round(2)
        label, want = list(range(40)), []
        for i in np.argsort(w, kind="stable"):
            x, y = label[a[i]], label[b[i]]
            if x != y:
                want.append(w[i])
                label = [x if z == y else z for z in label]
        assert sorted(w[D._forest(a, b, w)]) == want


def test_thinned_links_have_the_same_components_at_every_weight(spark):
    """Links between blocks are many times the points; what the merges read is a forest of them."""
    rng = random.Random(6)
    rows = [(a, b, round(rng.random(), 2), a % 5) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(900)) if a != b]
    edges = spark.createDataFrame(rows, "a long, b long, w double, zone long")

    def components(links, most):
        low = list(range(60))
        for a, b, w, _ in links:
            if w <= most:
                x, y = low[a], low[b]
                low = [min(x, y) if z in (x, y) else z for z in low]
        return low
    for per_task in (1000, 200):  # one task; several, and again until few are dropped
        thin = [tuple(r) for r in D.thinned(edges, per_task).collect()]
        assert set(thin) <= set(rows) and len(thin) < len(rows) // 2
        assert all(components(thin, w) == components(rows, w) for w in np.arange(0, 1.01, 0.01).round(2))
    assert len(D.thinned(edges).collect()) == 59  # a tree


def test_one_task_gives_the_same_merges_and_clusters_as_rounds(spark):
    """Links and trees that a task can hold are settled there, without rounds over the ladder or the tree."""
    for name, levels in (("copies", 8),):
        rows = case(name)
        pts, _ = N.points(spark.createDataFrame(list(rows.items()), "key long, vec array<double>").repartition(3), "key", "vec")
        radius, extent = N.first_radius(pts, min(N.GRID, len(rows[0])))
        cores, radii = N.core_distances(pts, 15, min(N.GRID, len(rows[0])), radius, extent)
        edges = D.links(pts, cores, radii, min(N.GRID, len(rows[0])))
        steps = D.ladder(edges, levels)
        made = []
        for per_task in (D.LINKS, 0):
            found = D.merges(pts, edges, steps, per_task)
            label = D.clusters_of(pts, found, steps, 15, radii[-1], per_task)
            groups = {}
            for r in label.collect():
                groups.setdefault(r.cluster, set()).add(r.pid)
            made.append((sorted(tuple(r) for r in found.collect()), sorted(map(sorted, groups.values()))))
        assert made[0] == made[1] and made[0][0] and made[0][1]


def test_two_blocks_keep_the_forest_of_all_their_links():
    """Whether all links are measured or only those that may be in it."""
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x, y = ([np.arange(n, n + 256), rng.uniform(0.9, 1.2, 256), np.arange(n, n + 256) // 2] for n in (0, 256))
        vx, vy = rng.normal(size=(2, 256, 8)).round(1)
        i, j, w = N.within(vx, vy, 6.0)
        w = np.maximum(w, np.maximum(x[1][i], y[1][j]))
        assert len(i) > D.MANY
        keep = D._forest(x[2][i], y[2][j], w)
        got = D._spanning(x, vx, y, vy, False, 6.0, [])
        assert all((p == q).all() for p, q in zip(got, (i[keep], j[keep], w[keep])))
        # links that join what lighter ones of the tile have joined are left out, the components at any weight stay
        tile = D._Links()
        cols = [x[0][got[0]], y[0][got[1]], x[2][got[0]], y[2][got[1]], got[2], np.zeros(len(got[0]))]
        tile.fold(cols)
        again = D._spanning(x, vx, y, vy, False, 6.0, tile.cuts)
        assert len(again[0]) <= len(got[0])
        both = np.concatenate([cols[2], x[2][again[0]]]), np.concatenate([cols[3], y[2][again[1]]]), np.concatenate([cols[4], again[2]])
        assert sorted(both[2][D._forest(*both)]) == sorted(got[2])


def test_a_tile_thins_links_that_wait(spark, monkeypatch):
    """What leaves a task is linear in its points, whatever number of blocks meet there."""
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(600)]
    pts, _ = N.points(spark.createDataFrame(rows, "key long, vec array<double>"), "key", "vec")
    radius, extent = N.first_radius(pts, 3)
    blocks = N.blocks
    monkeypatch.setattr(N, "blocks", lambda pts, side, dims, fields, comp=None: blocks(pts, side, dims, fields, comp, 16))
    cores, radii = N.core_distances(pts, 15, 3, radius, extent)
    v = np.array([v for _, v in rows])
    assert sorted(r.core for r in cores.collect()) == sorted(np.sort(N.distances(v, v), axis=1)[:, 14])
    made = []
    for most in (N.WAITING, 700):
        monkeypatch.setattr(N, "WAITING", most)
        made.append(D.links(pts, cores, radii, 3).toPandas())
    assert len(made[1]) < len(made[0])
    forests = [sorted(e.w[D._forest(e.a.to_numpy(), e.b.to_numpy(), e.w.to_numpy())]) for e in made]
    assert forests[0] == forests[1] and len(forests[0]) == 599


def test_radii_that_settle_no_point_are_left_out(spark, monkeypatch):
    """Far from the first radius; cores, their rounds and the radii are as if none was left out."""
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 1) for _ in range(12)]) for k in range(200)]
    pts, _ = N.points(spark.createDataFrame(rows, "key long, vec array<double>"), "key", "vec")
    _, extent = N.first_radius(pts, 3)
    asked, blocks = [], N.blocks
    monkeypatch.setattr(N, "blocks", lambda *a, **k: asked.append(a[1]) or blocks(*a, **k))
    cores, radii = N.core_distances(pts, 15, 3, extent / 1024, extent)
    assert len(set(asked)) < len(radii)
    assert all(r.core <= radii[r["round"]] and (r["round"] == 0 or r.core > radii[r["round"] - 1]) for r in cores.collect())
    assert max(r["round"] for r in cores.collect()) == len(radii) - 1
