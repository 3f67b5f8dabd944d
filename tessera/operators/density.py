"""Clusters of varying density (a density hierarchy with excess of mass).

Two points are linked at the radius at which both have ``min_size`` points around them
and they are within it of each other (mutual reachability). The components at all
radii form a tree; the clusters are the nodes of it that keep the most mass.

1. Core distances, by radii that double (``near.core_distances``).
2. Links. Again by radii that double: blocks of neighbouring cells meet, and a task
   emits a spanning forest of the links between different components of the radius
   before. Cells whose neighbourhood is in one component already do not take part,
   and two blocks of one component never meet; the links found hold a minimum
   spanning forest of all pairs, without a table of them. A task with more than a million
   links (``near.WAITING``) thins them to a forest of its own, so that the ladder below is
   then one of those that are left.
3. Ladder. The links' weights are cut into levels (exact percentiles, or every distinct
   weight with ``levels=None``). Then links are dealt by place and thinned to forests, as
   there are many times as many as points. The components of all levels are found by halving: the
   middle level's components are contracted for the upper half, and the links above
   it left out for the lower half, so that all parts of one depth are one call for
   components, each link is in one part, and the depth is the logarithm of the levels.
   The result is a table of merges (level, child, parent) with sizes. Links that one
   task can hold (a million), and a tree of clusters that one can hold, are settled there.
4. Tree. A merge of two or more children of ``min_size`` is a split of the parent, seen
   from above; one such child is the parent itself, which the other children leave.
   Stability of a cluster is the sum over its points of 1/eps where a point leaves
   less 1/eps where the cluster begins.
5. Excess of mass by joins, from the leaves up: a cluster is taken if it is more stable
   than what is taken below it; the root of everything never is.

Points of no cluster are noise (-1); clusters are numbered by their smallest key.
Items with a null vector are noise. With a ladder of all weights the result is that of
a sequential tree in which links of one weight merge at once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import near as N
from .graph import LINKS, _stars, connected_components

MIN_SIZE, LEVELS = 15, 32
SHRUNK = 0.7  # links are thinned again if no more than this share was left
MANY, FEW = 16_384, 4  # of so many links of two blocks a forest of every point's few lightest ones is made first


def _forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of a minimum spanning forest's links. A component's least link is the first
    one in order of weight at either of its ends."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    live = np.argsort(w, kind="stable")
    ends, label, taken = at.reshape(2, -1), np.arange(len(nodes)), []
    while True:
        x, y = label[ends[0, live]], label[ends[1, live]]
        far = x != y
        live, x, y = live[far], x[far], y[far]
        if not len(live):
            return np.concatenate(taken) if taken else np.zeros(0, np.int64)
        place = np.arange(len(live) - 1, -1, -1)
        least = np.full(len(nodes), -1)
        least[x[::-1]] = place  # the last one written is the first in order
        other = np.full(len(nodes), -1)
        other[y[::-1]] = place
        least = np.where((least < 0) | ((other >= 0) & (other < least)), other, least)
        pick = np.unique(least[least >= 0])
        taken.append(live[pick])
        x, y = x[pick], y[pick]
        low = np.arange(len(nodes))
        while True:
            lx, ly = low[x], low[y]
            if (lx == ly).all():
                break
            np.minimum.at(low, np.maximum(lx, ly), np.minimum(lx, ly))
            while (low[low] != low).any():
                low = low[low]
        label = low[label]


def _cuts(a: np.ndarray, b: np.ndarray, squared: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(squared weight, nodes, labels): what the links of a forest join up to some weights."""
    out = []
    for most in sorted({float(np.quantile(squared, q, method="lower")) for q in (0.5, 0.9, 1.0)}):
        light = squared <= most
        out.append((most, *_stars(a[light], b[light])))
    return out


def _needed(ok: np.ndarray, squared: np.ndarray, room: float, a: np.ndarray, b: np.ndarray, cuts) -> np.ndarray:
    """``ok`` without links that are heavier than others which join their ends already."""
    for most, nodes, label in cuts:
        def own(x, nodes=nodes, label=label):
            at = np.minimum(np.searchsorted(nodes, x), len(nodes) - 1)
            return np.where(nodes[at] == x, label[at], -1 - x)  # a node of no link is alone
        ok &= (squared <= most * (1 + 1e-12) + 2 * room) | (own(a)[:, None] != own(b)[None, :])
    return ok


class _Links(N.Tile):
    """Links (a, b, ca, cb, w, zone) of a tile; when many wait for output, they are thinned to a
    forest, and links heavier than what joins their ends in it are not looked at any more."""

    folds = True

    def __init__(self):
        self.cuts = []

    def fold(self, columns):
        keep = _forest(*columns[2:5])
        columns = [c[keep] for c in columns]
        self.cuts = _cuts(columns[2], columns[3], columns[4] ** 2)
        return columns


def _spanning(x, vx, y, vy, same: bool, r: float, cuts):
    """(i, j, w): a minimum spanning forest of the links of two blocks (pid, core, comp) between
    different components, up to the weight r. Only links that may be in it are measured."""
    squared, room = N.squares(vx, vy)
    ok = squared <= r * r + room
    ok &= (x[1] <= r)[:, None] & (y[1] <= r)[None, :]
    ok &= x[2][:, None] != y[2][None, :]
    if same:
        ok &= np.arange(len(vx))[:, None] < np.arange(len(vy))[None, :]
    np.maximum(squared, np.maximum((x[1] ** 2)[:, None], (y[1] ** 2)[None, :]), out=squared)
    ok = _needed(ok, squared, room, x[2], y[2], cuts)
    if np.count_nonzero(ok) > MANY and min(ok.shape) > FEW:
        few, some = np.where(ok, squared, np.inf), np.zeros_like(ok)
        np.put_along_axis(some, np.argpartition(few, FEW, axis=1)[:, :FEW], True, axis=1)
        np.put_along_axis(some, np.argpartition(few, FEW, axis=0)[:FEW], True, axis=0)
        i, j = np.nonzero(some & ok)
        a, b, w = x[2][i], y[2][j], few[i, j]
        keep = _forest(a, b, w)
        ok = _needed(ok, squared, room, x[2], y[2], _cuts(a[keep], b[keep], w[keep]))
    i, j = np.nonzero(ok)
    w = N.measured(vx, vy, i, j)
    near = w <= r
    i, j = i[near], j[near]
    w = np.maximum(w[near], np.maximum(x[1][i], y[1][j]))
    keep = _forest(x[2][i], y[2][j], w)
    return i[keep], j[keep], w[keep]


def _zone(v: np.ndarray, side: float, dims: int) -> int:
    """Number of the cell of a point, such that cells with near numbers mostly lie near each
    other: the bits of its coordinates in turn."""
    at = [min(max(int(x // side) + (1 << 19), 0), (1 << 20) - 1) for x in v[:min(dims, 3)]]
    return sum((c >> bit & 1) << bit * len(at) + i for i, c in enumerate(at) for bit in range(20))


def _thin(batches):
    rows = list(batches)
    if sum(b.num_rows for b in rows):
        t = pa.Table.from_batches(rows)
        keep = _forest(*(t[c].to_numpy() for c in ("a", "b", "w")))
        yield from t.take(pa.array(np.sort(keep))).combine_chunks().to_batches()


def thinned(edges: DataFrame, per_task: int = LINKS) -> DataFrame:
    """Fewer links with the same components up to any weight. Links are dealt by place, as
    many to a task as it can hold, and a task keeps a minimum spanning forest of its own;
    again with the links that are left, until one task holds them or few are dropped."""
    n = edges.count()
    while True:
        parts = max(1, -(-n // per_task))
        dealt = edges.coalesce(1) if parts == 1 else edges.repartitionByRange(parts, "zone", "a")
        edges = stored(dealt.mapInArrow(_thin, edges.schema), "thinned")
        left = edges.count()
        if parts == 1 or left > SHRUNK * n:
            return edges
        n = left


def _mixed(pts: DataFrame, side: float, dims: int) -> DataFrame:
    """Points of cells with several components around."""
    keys = [f"c{i}" for i in range(dims)]
    at = pts.select("*", *N.cells(side, dims))
    here = at.groupBy(*keys).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    around = N._around(here, dims).groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select(*keys)
    return stored(at.join(around, keys, "left_semi").drop(*keys), "mixed")


def links(pts: DataFrame, cores: DataFrame, radii: list[float], dims: int) -> DataFrame:
    """(a, b, w, zone): links that hold a minimum spanning forest of mutual reachability, w at
    most the last radius, and where a link lies."""
    whole = stored(pts.select("pid", "v").join(cores, "pid").withColumn("comp", F.col("pid")), "cored")
    found, start = None, whole.agg(F.min("round")).first()[0]
    for j, r in enumerate(radii):
        if start is None or j < start:  # no point is linked yet
            continue
        open_ = _mixed(whole.where(F.col("round") <= j), r, dims)
        if open_.isEmpty():
            continue
        table = N.blocks(open_, r, dims, ["pid", "core", "comp"], "comp")

        def spanning(x, vx, y, vy, same, known, task, r=r):
            i, j, w = _spanning(x, vx, y, vy, same, r, task.cuts)
            if not len(i):
                return None
            return x[0][i], y[0][j], x[2][i], y[2][j], w, np.full(len(i), _zone(vx[0], radii[0], dims))
        fields = ["pid", "core", "comp"]
        more = N.met(N.block_pairs(table, table, dims, symmetric=True), table, table, fields, fields, dims, spanning,
                     "a long, b long, ca long, cb long, w double, zone long", "spanning", _Links)
        found = more if found is None else found.unionByName(more)
        if j + 1 < len(radii):
            merged = connected_components(more.select(F.col("ca").alias("id")).union(more.select("cb")), more.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            whole = stored(whole.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left")
                           .select("pid", "v", "core", "round", F.coalesce("to", "comp").alias("comp")), "cored")
    if found is None:
        return pts.sparkSession.createDataFrame([], "a long, b long, w double, zone long")
    return found.select("a", "b", "w", "zone")


def ladder(edges: DataFrame, levels: int | None = LEVELS) -> list[float]:
    """Rising weights; the last is the largest. Exact percentiles, as ``F.percentile`` has
    them, but from the places of a sorted table: that function holds all weights in one
    task."""
    if levels is None:
        return [r[0] for r in edges.select("w").distinct().orderBy("w").collect()]
    rows = stored(edges.select("w").repartitionByRange("w").sortWithinPartitions("w").withColumn("_at", F.monotonically_increasing_id()), "ranged")
    counts = rows.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy("p").collect()  # a row a partition
    n = sum(c["n"] for c in counts)
    if not n:
        return []
    wanted = [(n - 1) * ((i + 1) / levels) for i in range(levels)]
    ids, before = {}, 0
    for c in counts:
        ids |= {int(c["first"]) + r - before: r for x in wanted for r in (math.floor(x), math.ceil(x)) if before <= r < before + c["n"]}
        before += c["n"]
    at = {ids[r["_at"]]: r["w"] for r in rows.where(F.col("_at").isin(list(ids))).collect()}
    steps = set()
    for x in wanted:
        lo, hi = math.floor(x), math.ceil(x)
        steps.add(at[lo] if lo == hi or at[lo] == at[hi] else (hi - x) * at[lo] + (x - lo) * at[hi])
    return sorted(steps)


MERGES = "level int, child long, child_size long, parent long, parent_size long"


def _merged(batches):
    """Merges of links (a, b, wa, wb, level), wa and wb being the ends' weights."""
    rows = list(batches)
    if not sum(b.num_rows for b in rows):
        return
    t = pa.Table.from_batches(rows)
    a, b, wa, wb, level = (t[c].to_numpy() for c in ("a", "b", "wa", "wb", "level"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    size = np.zeros(len(nodes), np.int64)
    size[at] = np.concatenate([wa, wb])
    low, ends = np.arange(len(nodes)), at.reshape(2, -1)

    def find(x):
        top = x
        while (low[top] != top).any():
            top = low[top]
        low[x] = top
        return top
    order = np.argsort(level, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        x, y = find(ends[0, mine]), find(ends[1, mine])
        if (x == y).all():
            continue
        child, to = _stars(x[x != y], y[x != y])
        parent, which = np.unique(to, return_inverse=True)
        whole = np.zeros(len(parent), np.int64)
        np.add.at(whole, which, size[child])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(child), level[mine[0]]), pa.int32()), pa.array(nodes[child]), pa.array(size[child]),
                                          pa.array(nodes[to]), pa.array(whole[which])], ["level", "child", "child_size", "parent", "parent_size"])
        low[child], size[parent] = to, whole


def merges(pts: DataFrame, edges: DataFrame, steps: list[float], per_task: int = LINKS) -> DataFrame:
    """(level, child, child_size, parent, parent_size): components that others join, at each
    level, with the sizes before and after. A component's id is its smallest point. One task
    goes through the levels if it can hold the links; otherwise the ladder is halved."""
    n = len(steps)
    rungs = F.array(*[F.lit(x) for x in steps])
    if edges.count() <= per_task:
        weight = pts.select("pid", "weight")
        sized = (edges.select("a", "b", F.size(F.filter(rungs, lambda x: x < F.col("w"))).alias("level"))
                 .join(weight.withColumnsRenamed({"pid": "a", "weight": "wa"}), "a").join(weight.withColumnsRenamed({"pid": "b", "weight": "wb"}), "b"))
        return stored(stored(sized, "sized").coalesce(1).mapInArrow(_merged, MERGES), "merges")
    live = stored(edges.select("a", "b", F.size(F.filter(rungs, lambda x: x < F.col("w"))).alias("level"))
                  .select(F.lit(-1).alias("lo"), F.lit(n - 1).alias("hi"), "a", "b", "level"), "part")
    sizes = pts.select(F.lit(-1).alias("lo"), F.lit(n - 1).alias("hi"), F.col("pid").alias("id"), F.col("weight").alias("size"))
    out = []
    while not live.isEmpty():
        middle = F.expr("CASE WHEN hi - lo = 1 THEN hi ELSE (lo + hi) DIV 2 END").cast("int")
        live = live.withColumn("mid", middle)
        # a component may be in several parts, so nodes are numbered by part and id
        ends = live.select("lo", "hi", F.col("a").alias("id")).union(live.select("lo", "hi", "b")).distinct()
        named = stored(ends.join(sizes, ["lo", "hi", "id"]).withColumn("node", F.monotonically_increasing_id()), "nodes")
        low = live.where(F.col("level") <= F.col("mid"))
        a = named.select("lo", "hi", F.col("id").alias("a"), F.col("node").alias("na"))
        b = named.select("lo", "hi", F.col("id").alias("b"), F.col("node").alias("nb"))
        joined = low.join(a, ["lo", "hi", "a"]).join(b, ["lo", "hi", "b"]).select(F.col("na").alias("a"), F.col("nb").alias("b"))
        comps = connected_components(named.select(F.col("node").alias("id")), joined)
        state = named.join(comps.withColumnsRenamed({"id": "node", "comp": "group"}), "node")
        groups = state.groupBy("group").agg(F.min("id").alias("parent"), F.sum("size").alias("parent_size"), F.count("*").alias("n"))
        state = stored(state.join(groups, "group").withColumn("mid", middle), "state")
        done = state.where((F.col("hi") - F.col("lo") == 1) & (F.col("n") > 1))
        out.append(done.select(F.col("hi").alias("level"), F.col("id").alias("child"), F.col("size").alias("child_size"), "parent", "parent_size"))
        # the lower half: links up to the middle, between the same nodes
        below = live.where((F.col("hi") - F.col("lo") > 1) & (F.col("level") <= F.col("mid"))).select("lo", F.col("mid").alias("hi"), "a", "b", "level")
        below_sizes = state.where("hi - lo > 1").select("lo", F.col("mid").alias("hi"), "id", "size")
        # the upper half: links above it, between the components at the middle
        pa = state.select("lo", "hi", F.col("id").alias("a"), F.col("parent").alias("ta"))
        pb = state.select("lo", "hi", F.col("id").alias("b"), F.col("parent").alias("tb"))
        above = (live.where((F.col("hi") - F.col("lo") > 1) & (F.col("level") > F.col("mid"))).join(pa, ["lo", "hi", "a"]).join(pb, ["lo", "hi", "b"])
                 .where("ta != tb").select(F.col("mid").alias("lo"), "hi", F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"), "level"))
        above = above.groupBy("lo", "hi", "a", "b").agg(F.min("level").alias("level"))
        above_sizes = state.where("hi - lo > 1").select(F.col("mid").alias("lo"), "hi", F.col("parent").alias("id"), F.col("parent_size").alias("size")).distinct()
        live = stored(below.unionByName(above.select(below.columns)), "part")
        sizes = below_sizes.unionByName(above_sizes)
    spark = pts.sparkSession
    if not out:
        return spark.createDataFrame([], MERGES)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return stored(whole, "merges")


def _events(found: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Events (event, level, size, kept, leavers) and their children (event, child: an
    earlier event or null, pid: the child if it is a single point, big)."""
    events = found.groupBy("level", "parent").agg(
        F.max("parent_size").alias("size"), F.sum((F.col("child_size") >= min_size).cast("long")).alias("kept"),
        F.sum(F.when(F.col("child_size") < min_size, F.col("child_size")).otherwise(0)).alias("leavers"))
    events = stored(events.withColumn("event", F.monotonically_increasing_id()), "events")
    # a component's history: made at a level under its id, gone at a later one
    made = events.select(F.col("parent").alias("id"), "level", F.lit(1).alias("made"), "event", F.lit(None).cast("long").alias("size"))
    gone = (found.join(events.select("level", "parent", "event"), ["level", "parent"])
            .select(F.col("child").alias("id"), "level", F.lit(0).alias("made"), "event", F.col("child_size").alias("size")))
    history = Window.partitionBy("id").orderBy("level", "made")
    last = F.last(F.when(F.col("made") == 1, F.col("event")), ignorenulls=True).over(history)
    joined = made.unionByName(gone).withColumn("child", last).where("made = 0")
    return events, stored(joined.select("event", "child", F.col("id").alias("pid"), (F.col("size") >= min_size).alias("big"), F.col("size").alias("child_size")), "children")


def _chosen(single: bool):
    """Excess of mass over a whole tree (cluster, up, head, stability, root) in one task."""
    def run(batches):
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        t = pa.Table.from_batches(rows)
        at = {c: k for k, c in enumerate(t["cluster"].to_pylist())}
        up = [-1 if u is None else at[u] for u in t["up"].to_pylist()]
        kids, order = [0] * len(up), []
        for u in up:
            if u >= 0:
                kids[u] += 1
        ready = [k for k, n in enumerate(kids) if not n]
        while ready:
            k = ready.pop()
            order.append(k)
            if up[k] >= 0:
                kids[up[k]] -= 1
                if not kids[up[k]]:
                    ready.append(up[k])
        stability, root = t["stability"].to_pylist(), t["root"].to_pylist()
        below, own, done = [0.0] * len(up), [False] * len(up), [False] * len(up)  # done: it or one above it is taken
        for k in order:
            own[k] = not (root[k] and single) and stability[k] >= below[k]
            if up[k] >= 0:
                below[up[k]] += stability[k] if own[k] else below[k]
        taken = []
        for k in reversed(order):
            done[k] = up[k] >= 0 and done[up[k]]
            if own[k] and not done[k]:
                done[k] = True
                taken.append(k)
        yield from t.select(["cluster", "up", "head"]).take(pa.array(sorted(taken), pa.int64())).combine_chunks().to_batches()
    return run


def _taken(tree: DataFrame, single: bool, per_task: int = LINKS) -> DataFrame:
    """(cluster, up, head) of the clusters that keep the most mass, from (cluster, up, head,
    stability, root). One task settles a tree that it can hold; otherwise a round settles a
    depth. ``single``: there is one root, which is never taken."""
    if tree.count() <= per_task:
        return stored(tree.coalesce(1).mapInArrow(_chosen(single), tree.select("cluster", "up", "head").schema), "taken")
    # from the leaves up: what is taken below a cluster, against its own stability
    open_, value = tree, None
    while not open_.isEmpty():
        parents = open_.select(F.col("up").alias("cluster")).where("cluster IS NOT NULL").distinct()
        ready = open_.join(parents, "cluster", "left_anti")
        if value is None:
            ready = ready.withColumn("below", F.lit(0.0))
        else:
            ready = ready.join(value.where("up IS NOT NULL").groupBy(F.col("up").alias("cluster")).agg(F.sum("value").alias("below")), "cluster", "left").withColumn("below", F.coalesce("below", F.lit(0.0)))
        barred = F.col("root") & F.lit(single)
        own = ~barred & (F.col("stability") >= F.col("below"))
        ready = ready.select("cluster", "up", "head", "root", own.alias("own"), F.when(own, F.col("stability")).otherwise(F.col("below")).alias("value"))
        value = stored(ready if value is None else value.unionByName(ready), "value")
        open_ = stored(open_.join(ready.select("cluster"), "cluster", "left_anti"), "open")
    if value is None:
        return tree.select("cluster", "up", "head")
    # from the root down: a cluster counts if nothing above it is taken
    taken, front = value.where("own AND up IS NULL"), value.where("NOT own AND up IS NULL").select("cluster")
    while not front.isEmpty():
        next_ = stored(value.join(front.withColumnRenamed("cluster", "up"), "up").select("cluster", "up", "head", "root", "own", "value"), "front")
        taken = taken.unionByName(next_.where("own"))
        front = next_.where("NOT own").select("cluster")
    return stored(taken.select("cluster", "up", "head"), "taken")


def clusters_of(pts: DataFrame, found: DataFrame, steps: list[float], min_size: int, top: float, per_task: int = LINKS) -> DataFrame:
    """(pid, cluster): a cluster's id is any number of its own; other points are absent.
    ``top`` is the radius up to which links were sought."""
    positive = [x for x in steps if x > 0]
    least = positive[0] if positive else 1.0
    rate = F.array(*[F.lit(1.0 / max(x, least)) for x in steps])
    events, children = _events(found, min_size)
    big = events.where(F.col("size") >= min_size).select("*", F.element_at(rate, F.col("level") + 1).alias("rate"))
    # single points (of weight min_size or more) can be big children without an event of their own
    alone = children.where("big AND child IS NULL").select(F.col("pid"), "child_size").distinct()
    alone = stored(alone.withColumn("event", -F.col("pid") - 1), "alone")
    kids = children.where("big").select("event", F.coalesce("child", -F.col("pid") - 1).alias("child"))
    kids = stored(kids, "kids")
    # an event with one big child is that child's cluster
    same = kids.join(big.where("kept = 1").select("event"), "event", "left_semi")
    ids = big.select("event").union(alone.select("event"))
    chains = stored(connected_components(ids.select(F.col("event").alias("id")), same.select(F.col("event").alias("a"), F.col("child").alias("b"))), "chains")
    chain = chains.select(F.col("id").alias("event"), F.col("comp").alias("cluster"))
    mass = (big.join(chain, "event").select("cluster", F.when(F.col("kept") == 1, F.col("leavers")).otherwise(F.col("size")).alias("n"), "rate")
            .union(alone.join(chain, "event").select("cluster", F.col("child_size").alias("n"), F.lit(1.0 / least).alias("rate"))))
    mass = mass.groupBy("cluster").agg(F.sum(F.col("n") * F.col("rate")).alias("mass"), F.sum("n").alias("n"))
    # a cluster begins where it is one of several big children
    split = big.where("kept > 1").select("event", "rate")
    begins = (kids.join(split, "event").join(chain.withColumnsRenamed({"event": "child", "cluster": "own"}), "child")
              .join(chain, "event").select(F.col("own").alias("cluster"), F.col("cluster").alias("up"), F.col("rate").alias("start"), F.col("child").alias("head")))
    roots = F.col("up").isNull()
    tree = mass.join(begins, "cluster", "left")
    tree = stored(tree.select("cluster", "up", "head", (F.col("mass") - F.col("n") * F.coalesce("start", F.lit(1.0 / max(top, least)))).alias("stability"), roots.alias("root")), "tree")
    single = tree.where("root").count() == 1
    taken = _taken(tree, single, per_task)
    # points hang on their first event, events on the next; cut above the heads of those taken
    cut = taken.where("up IS NOT NULL").select(F.col("head").alias("child"))
    up = children.select("event", F.coalesce("child", -F.col("pid") - 1).alias("child")).join(cut, "child", "left_anti")
    nodes = events.select(F.col("event").alias("id")).union(pts.select((-F.col("pid") - 1).alias("id")))
    trees = stored(connected_components(nodes, up.select(F.col("event").alias("a"), F.col("child").alias("b"))), "trees")
    marks = (chain.join(taken.select("cluster"), "cluster").join(trees.select(F.col("id").alias("event"), "comp"), "event").select("comp", "cluster").distinct())
    return trees.where("id < 0").join(marks, "comp").select((-F.col("id") - 1).alias("pid"), "cluster")


def density(items: DataFrame, key: str, vec: str, min_size: int = MIN_SIZE, levels: int | None = LEVELS, eps_max: float | None = None,
            grid_dims: int = N.GRID) -> DataFrame:
    """(key, cluster). ``eps_max`` bounds the radii: points with fewer than ``min_size``
    points within it are noise, and components farther apart are not joined; without
    it radii go on until every point has its core distance."""
    pts, members = N.points(items, key, vec)
    first = pts.select(F.size("v")).first()
    label = None
    if first is not None:
        dims = min(grid_dims, first[0])
        radius, extent = N.first_radius(pts, dims)
        if extent == 0.0:  # one point alone
            pass  # one point is one cluster at most, and the only one is never taken
        else:
            cores, radii = N.core_distances(pts, min_size, dims, radius, extent, eps_max)
            edges = links(pts, cores, radii, dims)
            steps = ladder(edges, levels)
            label = clusters_of(pts, merges(pts, thinned(edges), steps), steps, min_size, radii[-1]) if steps else None
    if label is None:
        return items.select(key, F.lit(-1).cast("int").alias("cluster"))
    named = stored(members.join(label, "pid").select("id", F.col("cluster").alias("_c")), "labelled")
    heads = stored(named.groupBy("_c").agg(F.min("id").alias("_head")), "heads")
    numbers = heads.join(N.dense_index(heads, "_head", "cluster"), "_head").select("_c", "cluster")
    named = named.join(numbers, "_c").select(F.col("id").alias(key), "cluster")
    return items.select(key).join(named, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
