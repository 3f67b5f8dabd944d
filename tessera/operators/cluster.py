"""Clustering (G3a KMeans, G3b DBSCAN; G3c is in ``density``).

DBSCAN without a table of pairs. Identical vectors are one weighted point. A cell of
side eps/sqrt(d) has a diagonal of eps: with ``min_samples`` rows all its points are
core points, and the core points of a cell are one cluster, in both cases without
looking at a pair. Points of sparser cells count their neighbours block by block, up to
``min_samples``. Then blocks of different components meet (``near``), and a task emits a
spanning forest of the links between them. Border points take the smallest cluster
among their core neighbours, everything else is noise (-1). Cluster numbers are 0.. in
order of each cluster's smallest core key."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as VF
from ..session import stored
from . import graph as G
from . import near as N
from .density import _forest, _mixed, density
from .near import dense_index

METHODS = ("HDBSCAN", "DBSCAN", "KMeans")


def check_method(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"Unknown clustering method: {method}")
    return method


class _Counts(N.Tile):
    """Numbers of neighbours, or the least clusters of neighbours, of a tile's left points."""

    def __init__(self, first: int):
        self.first = first

    def begin(self, fields, v):
        return np.full(len(v), self.first)

    def end(self, fields, known):
        some = known != self.first
        return (fields[0][some], known[some]) if some.any() else None


class _Joined(N.Tile):
    """What the links of a tile have joined so far."""

    def __init__(self):
        self.nodes = self.label = np.zeros(0, np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        if not len(self.nodes):
            return x
        at = np.minimum(np.searchsorted(self.nodes, x), len(self.nodes) - 1)
        return np.where(self.nodes[at] == x, self.label[at], x)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.nodes, self.label = G._stars(np.concatenate([self.nodes, a]), np.concatenate([self.label, b]))


def _links(x, vx, y, vy, radius: float, task: _Joined):
    """Links within the radius that join components of the tile. Most points of two blocks are
    soon in one; only pairs with a point outside it are looked at."""
    a, b = task.of(x), task.of(y)
    names, n = np.unique(np.concatenate([a, b]), return_counts=True)
    if len(names) == 1:
        return None
    big = names[n.argmax()]
    parts = []
    for p, q in ((np.flatnonzero(a != big), np.arange(len(b))), (np.flatnonzero(a == big), np.flatnonzero(b != big))):
        if len(p) and len(q):
            i, j = np.nonzero(N.are_within(vx[p], vy[q], radius) & (a[p][:, None] != b[q][None, :]))
            parts.append((p[i], q[j]))
    i, j = (np.concatenate(c) for c in zip(*parts))
    if not len(i):
        return None
    keep = _forest(a[i], b[j], np.zeros(len(i)))
    i, j = i[keep], j[keep]
    task.join(x[i], y[j])
    return x[i], y[j]


def dbscan(items: DataFrame, key: str, vec: str, eps: float = 0.2, min_samples: int = 15,
           metric: str = "cosine", grid_dims: int = N.GRID) -> DataFrame:
    """(key, cluster). ``metric`` 'cosine' (distance 1 - cos, a vector without length is
    at a distance of 1 from all) or 'euclidean'. A null vector is noise."""
    v = F.col(vec).cast("array<double>")
    if metric == "cosine":
        # 1 - cos <= eps on unit vectors is a distance of sqrt(2 eps) at most; zero vectors stay alone
        rows = items.select(F.col(key).alias("key"), F.when(VF.norm(v) > 0, VF.l2_normalize(v)).alias("v"))
        radius = (2.0 * float(eps)) ** 0.5
    else:
        rows, radius = items.select(F.col(key).alias("key"), v.alias("v")), float(eps)
    pts, members = N.points(rows, "key", "v")
    first = pts.select(F.size("v")).first()
    if first is None:
        return items.select(key, F.lit(-1).cast("int").alias("cluster"))
    d = first[0]
    dims = min(grid_dims, d)
    side = F.lit(radius * (1 - 1e-9) / max(d, 1) ** 0.5)
    cell = F.xxhash64(F.transform("v", lambda x: F.floor(x / side)), F.lit(0))
    pts = stored(pts.withColumn("cell", cell), "points")
    full = pts.groupBy("cell").agg(F.sum("weight").alias("n")).where(F.col("n") >= min_samples).select("cell")
    sparse = stored(pts.join(full, "cell", "left_anti"), "sparse")

    def count(x, vx, y, vy, same, known, task):
        few = np.flatnonzero(known < min_samples)  # others are core points already
        if len(few):
            n = N.are_within(vx[few], vy, radius).astype(np.int64) @ np.minimum(y[0], min_samples)
            known[few] = np.minimum(known[few] + n, min_samples)
    a, b = N.blocks(sparse, radius, dims, ["pid"]), N.blocks(pts, radius, dims, ["weight"])
    near = N.met(N.block_pairs(a, b, dims), a, b, ["pid"], ["weight"], dims, count, "pid long, n long", "counts", lambda: _Counts(0))
    dense = near.groupBy("pid").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("pid")
    core = stored(pts.join(full, "cell", "left_semi").unionByName(sparse.join(dense, "pid", "left_semi")), "core")
    one = core.groupBy("cell").agg(F.min("pid").alias("comp"))
    core = stored(core.join(one, "cell").select("pid", "v", "comp"), "core")

    def spanning(x, vx, y, vy, same, known, task):
        return _links(x[0], vx, y[0], vy, radius, task)
    c = N.blocks(_mixed(core, radius, dims), radius, dims, ["comp"], "comp")
    links = N.met(N.block_pairs(c, c, dims, symmetric=True), c, c, ["comp"], ["comp"], dims, spanning, "a long, b long", "spanning", _Joined)
    comps = G.connected_components(core.select(F.col("comp").alias("id")), links)
    core = core.join(comps.select(F.col("comp").alias("group"), F.col("id").alias("comp")), "comp").select("pid", "v", "group")
    heads = core.join(members, "pid").groupBy("group").agg(F.min("id").alias("head"))
    heads = stored(heads, "heads")
    numbers = heads.join(dense_index(heads, "head", "cluster"), "head").select("group", F.col("cluster").cast("long"))
    core = stored(core.join(numbers, "group").select("pid", "v", "cluster"), "clusters")

    none = np.iinfo(np.int64).max

    def lowest(x, vx, y, vy, same, known, task):
        more = np.flatnonzero(known > y[0].min())
        if len(more):
            near = N.are_within(vx[more], vy, radius)
            known[more] = np.minimum(known[more], np.where(near, y[0][None, :], none).min(axis=1))
    rest = stored(sparse.join(core.select("pid"), "pid", "left_anti"), "rest")
    a, b = N.blocks(rest, radius, dims, ["pid"]), N.blocks(core, radius, dims, ["cluster"])
    border = N.met(N.block_pairs(a, b, dims), a, b, ["pid"], ["cluster"], dims, lowest, "pid long, cluster long", "border", lambda: _Counts(none))
    labelled = core.select("pid", "cluster").unionByName(border.groupBy("pid").agg(F.min("cluster").alias("cluster")))
    named = members.join(labelled, "pid").select(F.col("id").alias(key), "cluster")
    return items.select(key).join(named, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def kmeans_fit(items: DataFrame, key: str, vec: str, k: int = 10, seed: int = 42):
    """(labels (key, cluster), fitted MLlib model). Rows are sorted by key
    first so the same input and partition count give the same model."""
    x = items.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("x")).orderBy(key)
    model = KMeans(k=int(k), seed=int(seed), featuresCol="x", predictionCol="cluster").fit(x)
    return model.transform(x).select(key, F.col("cluster").cast("int")), model


def kmeans(items: DataFrame, key: str, vec: str, k: int = 10, seed: int = 42) -> DataFrame:
    return kmeans_fit(items, key, vec, k, seed)[0]


def kmeans_assign(model, items: DataFrame, key: str, vec: str) -> DataFrame:
    """Nearest centre of a fitted model for new vectors (k centres live in the
    model; no pair search)."""
    x = items.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("x"))
    return model.transform(x).select(key, F.col("cluster").cast("int"))
