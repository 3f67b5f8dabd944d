"""Similar pairs and graph algorithms (J7, G5, components).

* ``cosine_pairs``: all pairs above a cosine, found in blocks of neighbouring cells
  (``near``) on the vectors' principal axes, by one product of two blocks.
* ``connected_components``: partitions settle their own links; what is left goes
  through alternating large-star and small-star steps, until all components are
  stars. Each step is a table in the shared folder.
* ``leader_groups``: the greedy "earliest ungrouped topic leads, later similar
  ungrouped topics join it" rule, in rounds over blocks of consecutive ranks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as VF
from ..session import stored
from . import near as N

LINKS = 1_000_000  # links that one task settles by itself
RANKS = 4_096  # consecutive ranks that one pass settles


def _rotated(rows: DataFrame) -> DataFrame:
    """Unit vectors v turned to their principal axes, by falling variance, which keeps all
    dot products. The axes (d x d numbers) come from one distributed covariance."""
    d = rows.select(F.size("v")).first()
    if d is None or d[0] < 2:
        return rows
    axes = PCA(k=d[0], inputCol="x", outputCol="y").fit(rows.select(array_to_vector("v").alias("x"))).pc.toArray()
    axes = np.linalg.qr(axes)[0]  # an exactly orthogonal basis, also where the data have no variance

    def run(batches):
        for b in batches:
            v = b.column("v")
            out = np.asarray(v.flatten().to_numpy()).reshape(b.num_rows, d[0]) @ axes
            at = b.schema.get_field_index("v")
            yield b.set_column(at, "v", pa.ListArray.from_arrays(np.arange(0, out.size + 1, d[0], dtype=np.int32), pa.array(out.ravel())))
    return rows.mapInArrow(run, rows.schema)


def _alike(items: DataFrame, key: str, vec: str, threshold: float, grid_dims: int, counted: bool):
    """Pairs of the items' numbers with their cosines, or numbers of pairs that were looked at in full."""
    if threshold <= 0:
        raise ValueError("a threshold above 0 is needed")
    v = F.col(vec).cast("array<double>")
    rows = items.select(F.col(key).alias("id"), v.alias("v")).where(VF.norm(F.col("v")) > 0)
    rows = stored(rows.select("id", VF.l2_normalize(F.col("v")).alias("v"), F.monotonically_increasing_id().alias("pid")), "unit")
    # whole numbers go along as they are; other ids are joined to the pairs
    name = "id" if rows.schema["id"].dataType.simpleString() == "bigint" else "pid"
    turned = stored(_rotated(rows.where(F.col(name).isNotNull()).select("pid", "id", "v")), "rotated")
    radius = max(2.0 * (1.0 - float(threshold)), 0.0) ** 0.5 + 1e-7
    first = turned.select(F.size("v")).first()
    dims = min(grid_dims, first[0]) if first else 1
    table = N.blocks(turned, radius, dims, [name])

    def work(x, vx, y, vy, same):
        maybe = vx @ vy.T >= threshold - 1e-9  # one product, with room for its rounding
        if same:
            maybe &= np.arange(len(vx))[:, None] < np.arange(len(vy))[None, :]
        i, j = np.nonzero(maybe)
        if counted:
            return np.array([len(i)]), np.array([0]), np.array([0.0])
        cosine = np.einsum("ij,ij->i", vx[i], vy[j])
        ok = cosine >= threshold
        return (x[0][i[ok]], y[0][j[ok]], cosine[ok]) if ok.any() else None
    found = N.met(N.block_pairs(table, table, dims, symmetric=True), table, table, [name], [name], dims, work, "a long, b long, cosine double", "alike")
    return rows, found, name == "id"


def cosine_pairs(items: DataFrame, key: str, vec: str, threshold: float, grid_dims: int = N.GRID) -> DataFrame:
    """(a, b, cosine) for a < b with cosine ≥ threshold (above 0), exact. Vectors are
    turned to their principal axes; blocks of neighbouring cells of the leading ones
    meet; one product of two blocks finds the pairs whose cosine is measured."""
    rows, found, named = _alike(items, key, vec, threshold, grid_dims, False)
    if named:
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").where("a < b")
    ids = rows.select("id", "pid")
    pairs = found.join(ids.select(F.col("pid").alias("a"), F.col("id").alias("ia")), "a").join(ids.select(F.col("pid").alias("b"), F.col("id").alias("ib")), "b")
    return pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "cosine").where("a < b")


def candidate_share(items: DataFrame, key: str, vec: str, threshold: float, grid_dims: int = N.GRID) -> float:
    """Share of all pairs that ``cosine_pairs`` looks at in full."""
    rows, found, _ = _alike(items, key, vec, threshold, grid_dims, True)
    n = rows.count()
    return (found.agg(F.sum("a")).first()[0] or 0) / max(1, n * (n - 1) // 2)


def _are_stars(links: DataFrame) -> bool:
    """Whether every node of (a, b) has one link at most and no link leads to a node with a link."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        links.select("b", F.lit(0), F.lit(1)))
    per = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per.where("out > 1 OR out > 0 AND into > 0").isEmpty()


def _stars(a, b):
    """Smallest label of every node's component, from the ends of links as numpy arrays:
    (nodes, labels)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    low = np.arange(len(nodes))
    while True:
        la, lb = low[a], low[b]
        if (la == lb).all():
            return nodes, nodes[low]
        np.minimum.at(low, np.maximum(la, lb), np.minimum(la, lb))
        while (low[low] != low).any():
            low = low[low]


def _settled(links: DataFrame, size: int = LINKS) -> tuple[DataFrame, bool]:
    """Links with the components within every partition made stars, and whether all were in
    one partition. Partitions hold about ``size`` links."""
    n = links.count()
    parts = max(1, -(-n // size))
    kind = links.schema["a"].dataType.simpleString()

    def run(batches):
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        nodes, label = _stars(*(np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in rows]) for c in ("a", "b")))
        far = nodes != label
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(label[far])], ["a", "b"])
    dealt = links.coalesce(1) if parts == 1 else links.repartition(parts, "a", "b")  # both, as a hub's links would all be in one partition
    return stored(dealt.mapInArrow(run, f"a {kind}, b {kind}"), "links"), parts == 1


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id", per_task: int = LINKS) -> DataFrame:
    """(id, comp) where comp is the smallest id in the node's component.
    ``edges`` has columns (a, b), undirected.

    A partition of links settles its own components in one pass, so links that fill
    one partition need no round at all. Otherwise alternates the large-star and small-star steps of Kiveris et al. (2014) on
    links from larger to smaller ids. Large star: a link to b goes to b's smallest
    smaller neighbour instead. Small star: a node's smaller neighbours, and the
    node, are linked to the smallest of them. Distances at least halve, so a path
    of n nodes needs O(log² n) rounds at most; the loop ends when all components
    are stars around their smallest id. What a join reads is stored first, so a
    hub's links arrive in a shuffle that Spark may split."""
    links = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    plain = links.schema["a"].dataType.simpleString() in ("bigint", "int", "string")
    links, done = _settled(links, per_task) if plain else (links, False)
    while not done and not _are_stars(links):
        low = stored(links.groupBy("a").agg(F.min("b").alias("m")), "low")
        large = links.join(low.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        large = stored(large, "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        moved = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        links = stored(large.join(low, "a").select(moved.alias("a"), F.col("m").alias("b")).distinct(), "links")
    ids = nodes.select(F.col(node).alias("id")).distinct()
    return ids.join(links.withColumnsRenamed({"a": "id", "b": "comp"}), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def leader_groups(nodes: DataFrame, edges: DataFrame, node: str = "id", order: str = "rank", block: int = RANKS) -> DataFrame:
    """(id, leader). ``nodes`` has a total ``order`` (smaller = earlier,
    i.e. more popular); ``edges`` (a, b) are undirected similarity pairs.

    Same result as the sequential greedy loop: a node leads when no earlier
    leader is its neighbour; a non-leader belongs to its earliest neighbouring
    leader. Nodes are dealt into blocks of ``block`` consecutive ranks. In a round every
    block walks through its undecided nodes in order of rank, knowing what was decided
    before and, of earlier blocks, whether a neighbour leads or is open; so a chain
    within a block is settled in one pass, and rounds follow the blocks that a chain
    passes and not its nodes."""
    ranks = N.dense_index(nodes, order, "rk")
    rk = stored(nodes.select(F.col(node).alias("id"), F.col(order)).join(ranks, order).select("id", F.col("rk").cast("long").alias("rk")), "ranks")
    e = (edges.select("a", "b").join(rk.select(F.col("id").alias("a"), F.col("rk").alias("ra")), "a")
         .join(rk.select(F.col("id").alias("b"), F.col("rk").alias("rb")), "b").where("ra != rb"))
    e = stored(e.select(F.least("ra", "rb").alias("p"), F.greatest("ra", "rb").alias("rk")).distinct(), "edges")  # earlier, later
    at = lambda c: F.floor(F.col(c) / F.lit(block))
    inner = e.where(at("p") == at("rk")).groupBy("rk").agg(F.collect_list("p").alias("near"))  # block - 1 at most
    outer = e.where(at("p") != at("rk"))
    base = stored(rk.select("rk", at("rk").alias("block")).join(inner, "rk", "left").select("rk", "block", F.coalesce("near", F.array().cast("array<long>")).alias("near")), "ranked")
    state = base.select("rk", F.lit(0).alias("st"))  # 0 open, 1 leads, 2 follows
    while True:
        seen = (outer.join(state.withColumnsRenamed({"rk": "p", "st": "pst"}), "p").groupBy("rk")
                .agg(F.max((F.col("pst") == 1).cast("int")).alias("led"), F.max((F.col("pst") == 0).cast("int")).alias("wait")))
        rows = base.join(state, "rk").join(seen, "rk", "left").select("block", "rk", "st", "near", F.coalesce("led", F.lit(0)).alias("led"), F.coalesce("wait", F.lit(0)).alias("wait"))
        state = stored(rows.groupBy("block").applyInArrow(_walk, "rk long, st int"), "state")
        if state.where("st = 0").isEmpty():
            break
    names = rk.select("id", "rk")
    lead = state.where("st = 1").select("rk")
    first = e.join(lead.select(F.col("rk").alias("p")), "p").groupBy("rk").agg(F.min("p").alias("p"))
    follow = state.where("st = 2").select("rk").join(first, "rk")
    both = lead.select("rk", F.col("rk").alias("p")).unionByName(follow)
    return both.join(names, "rk").join(names.select(F.col("rk").alias("p"), F.col("id").alias("leader")), "p").select("id", "leader")


def _walk(table: pa.Table) -> pa.Table:
    """The states of a block's nodes after one pass in order of rank."""
    rows = table.select(["rk", "st", "near", "led", "wait"]).sort_by("rk").to_pylist()
    state = {r["rk"]: r["st"] for r in rows}
    for r in rows:
        if r["st"] == 0:
            near = [state[p] for p in r["near"]]
            if r["led"] or 1 in near:
                state[r["rk"]] = 2
            elif not r["wait"] and 0 not in near:
                state[r["rk"]] = 1
    return pa.table({"rk": pa.array(list(state), pa.int64()), "st": pa.array(list(state.values()), pa.int32())})
