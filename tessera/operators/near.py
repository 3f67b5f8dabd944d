"""Neighbours of vectors without a table of pairs.

Vectors lie in grid cells of the search radius on their leading coordinates, so
whatever is within the radius of a vector is in its cell or a neighbouring one. The
points of a cell are packed into blocks of bounded size, so a hot cell is many
blocks; blocks of neighbouring cells meet in an equi-join on the cell, and numpy
works on a whole pair of blocks in a task. Blocks lie in groups, and a task works on the
pairs of two groups, a tile: a block is moved once for each tile it is in, not for
each block it meets. What leaves a task is linear in its
points: counts, the nearest few, or a spanning forest; never the pairs.

Identical vectors are one point with a weight, so a vector that many rows share costs
as much as any other."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import arrow_rows, stored

BLOCK, PURE, GRID = 256, 64, 3
MIXED = -1
SOME = 1 / 64  # radii are left out after one that settles a smaller share
BLOCKS_AT_ONCE = 32  # blocks in one Arrow batch
ROWS_AT_ONCE = 1 << 18  # results in one Arrow batch, or those of one pair of blocks
WAITING = 1 << 20  # results of a tile that wait before they are folded
# a group of blocks holds about 32 MB at most; smaller tables are cut too, for parallel tasks
GROUP_BYTES, GROUPS, GROUP_POINTS = 32 << 20, 6, 1024


def points(items: DataFrame, key: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Points (pid, v, weight), one for each distinct vector, and the items' (id, pid).
    A null vector is no point."""
    rows = items.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    # -0.0 and 0.0 are one coordinate
    rows = stored(rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))), "vectors")
    found = stored(rows.groupBy("v").agg(F.count("*").alias("weight")).select(F.monotonically_increasing_id().alias("pid"), "v", "weight"), "points")
    return found, stored(rows.join(found.select("v", "pid"), "v").select("id", "pid"), "members")


def cells(side: float, dims: int, v: str = "v") -> list:
    wide = float(side) * (1 + 1e-9)  # rounding must not part two points that are the side apart
    return [F.floor(F.col(v)[i] / F.lit(wide)).cast("long").alias(f"c{i}") for i in range(dims)]


def blocks(pts: DataFrame, side: float, dims: int, fields: list[str], comp: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row a block: bid, cell c0.., own, fields as arrays, v as one flat array. With
    ``comp``, a component with many points of the cell has blocks of its own, whose
    ``own`` is the component; that of other blocks is MIXED."""
    keys = [f"c{i}" for i in range(dims)]
    at = pts.select("*", *cells(side, dims))
    if comp:
        per = at.groupBy(*keys, comp).agg(F.count("*").alias("_n")).select(*keys, comp, F.when(F.col("_n") >= PURE, F.col(comp)).otherwise(MIXED).alias("own"))
        at = at.join(per, [*keys, comp])
    else:
        at = at.withColumn("own", F.lit(MIXED).cast("long"))
    total = at.groupBy(*keys, "own").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("_salts"))
    at = at.join(total, [*keys, "own"]).withColumn("_s", F.pmod(F.xxhash64("pid"), F.col("_salts")))
    packed = at.groupBy(*keys, "own", "_s").agg(F.collect_list(F.struct(*fields, "v")).alias("x"))
    return stored(packed.select(F.monotonically_increasing_id().alias("bid"), *keys, "own",
                                *[F.col(f"x.{f}").alias(f) for f in fields], F.flatten("x.v").alias("v")), "blocks")


def _around(frame: DataFrame, dims: int) -> DataFrame:
    """Every row once for each of the 3^dims cells around its own."""
    offsets = F.explode(F.array(*[F.array(*[F.lit(x) for x in o]) for o in itertools.product((-1, 0, 1), repeat=dims)]))
    moved = frame.withColumn("_o", offsets)
    for i in range(dims):
        moved = moved.withColumn(f"c{i}", F.col(f"c{i}") + F.col("_o")[i])
    return moved.drop("_o")


def block_pairs(left: DataFrame, right: DataFrame, dims: int, symmetric: bool = False) -> DataFrame:
    """(l, r): ids of blocks in the same or neighbouring cells. ``symmetric``, of one
    table with itself: each pair once, and none of two blocks of one component."""
    keys = [f"c{i}" for i in range(dims)]
    a = _around(left.select(F.col("bid").alias("l"), F.col("own").alias("lo"), *keys), dims)
    both = a.join(right.select(F.col("bid").alias("r"), F.col("own").alias("ro"), *keys), keys)
    if symmetric:
        both = both.where((F.col("l") <= F.col("r")) & ((F.col("lo") != F.col("ro")) | (F.col("lo") == MIXED)))
    return both.select("l", "r")


def _groups(table: DataFrame, field: str) -> int:
    """Into how many groups the blocks of a table are dealt."""
    x = table.agg(F.sum(F.size("v")).alias("n"), F.sum(F.size(field)).alias("points")).first()
    return max(-(-8 * (x["n"] or 0) // GROUP_BYTES), min(GROUPS, -(-(x["points"] or 0) // GROUP_POINTS)), 1)


def met(pairs: DataFrame, left: DataFrame, right: DataFrame, left_fields: list[str], right_fields: list[str], dims: int,
        work: Callable, schema: str, name: str, tile: Callable | None = None) -> DataFrame:
    """Stored results of work(left fields, left vectors, right fields, right vectors, same)
    for every pair of blocks; it returns columns of the schema or None. In a table with
    itself, either block of a pair may be the left one.

    With ``tile``, work also gets what is known of its left block in the task, and what
    tile() made for the task: an object with ``begin(fields, vectors)``, which makes the
    former, ``end(fields, known)``, which turns it to columns or None when all pairs
    are done, and, if it ``folds``, ``fold(columns)``, which shrinks columns that wait for output.

    A tile, a group of left blocks and one of right blocks, is one partition: its left
    blocks are held, the right ones pass by with the ids of those they meet. A block goes
    to a tile once, and only if it meets one there, so what is moved grows with the
    blocks and the number of groups and not with the pairs."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    g = _groups(left, left_fields[0])
    h = g if right is left else _groups(right, right_fields[0])
    pairs = pairs.select("l", "r", F.pmod(F.xxhash64("l"), F.lit(g)).alias("lg"), F.pmod(F.xxhash64("r"), F.lit(h)).alias("rg"))
    if right is left:
        swap = lambda a, b: F.when(F.col("lg") > F.col("rg"), F.col(b)).otherwise(F.col(a)).alias(a)
        pairs = pairs.select(swap("l", "r"), swap("r", "l"), swap("lg", "rg"), swap("rg", "lg"))
    tiled = stored(pairs.select((F.col("lg") * h + F.col("rg")).cast("int").alias("tile"), "l", "r"), "tiled")
    fields = {**{f"l_{f}": left.schema[f].dataType for f in left_fields}, **{f"r_{f}": right.schema[f].dataType for f in right_fields}}

    def side(table: DataFrame, key: str, need: DataFrame) -> DataFrame:
        own = [F.col(f[2:]).alias(f) if f.startswith(f"{key}_") else F.lit(None).cast(t).alias(f) for f, t in fields.items()]
        return need.join(table.select(F.col("bid").alias(key), "v", *own), key).select("tile", F.col(key).alias("bid"), "meets", "v", *fields)
    held = side(left, "l", tiled.select("tile", "l").distinct().withColumn("meets", F.lit(None).cast("array<long>")))
    passing = side(right, "r", tiled.groupBy("tile", "r").agg(F.collect_list("l").alias("meets")))
    rows = held.unionByName(passing).repartitionById(g * h, F.col("tile")).sortWithinPartitions(F.col("meets").isNotNull())  # held ones first

    def run(batches):
        mine, out, size = {}, [], 0
        task = tile() if tile else None
        folds, folded = task is not None and task.folds, False
        full = WAITING if folds else ROWS_AT_ONCE
        for batch in batches:
            get = {c: batch.column(c) for c in ("meets", "v", *fields)}
            cut = lambda c, i: get[c][i].values.to_numpy(zero_copy_only=False)
            for i, bid in enumerate(batch.column("bid").to_pylist()):
                holds = not get["meets"][i].is_valid
                own = [cut(f"l_{f}", i) for f in left_fields] if holds else [cut(f"r_{f}", i) for f in right_fields]
                v = cut("v", i).reshape(len(own[0]), -1)
                if holds:
                    if bid not in mine:
                        mine[bid] = own, v, *((task.begin(own, v),) if task else ())
                    continue
                for other in cut("meets", i):
                    x, vx, *known = mine[other]
                    found = work(x, vx, own, v, other == bid, *known, *((task,) if task else ()))
                    if found is not None:
                        out.append(found)
                        size += len(found[0])
                    if size >= full:
                        if folds:
                            out = [task.fold([np.concatenate(c) for c in zip(*out)])]
                            size, folded = len(out[0][0]), True
                            full = max(WAITING, 2 * size)
                        else:
                            yield _batch(out, names, types)
                            out, size = [], 0
        if folded:
            out = [task.fold([np.concatenate(c) for c in zip(*out)])]
            size = len(out[0][0])
        for x, _, *known in mine.values() if task else ():
            found = task.end(x, *known)
            if found is not None:
                out.append(found)
                size += len(found[0])
            if size >= ROWS_AT_ONCE:
                yield _batch(out, names, types)
                out, size = [], 0
        if out:
            yield _batch(out, names, types)
    with arrow_rows(pairs.sparkSession, BLOCKS_AT_ONCE):
        return stored(rows.drop("tile").mapInArrow(run, schema), name)


def _batch(out: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([y for x in c for y in x], t) if pa.types.is_list(t) else pa.array(np.concatenate(c), t)
                                       for c, t in zip(zip(*out), types)], names)


class Tile:
    """What a task of ``met`` knows by itself; this one knows nothing."""

    folds = False

    def begin(self, fields: list[np.ndarray], v: np.ndarray):
        return None

    def end(self, fields: list[np.ndarray], known):
        return None


class Least(Tile):
    """Of every point of a left block the ``k`` least numbers, infinite where there are fewer."""

    def __init__(self, k: int):
        self.k = k

    def begin(self, fields, v):
        return np.full((len(v), self.k), np.inf)

    def end(self, fields, known):
        some = np.isfinite(known[:, 0])
        return (fields[0][some], [x[np.isfinite(x)] for x in known[some]]) if some.any() else None

    def add(self, known: np.ndarray, i: np.ndarray, d: np.ndarray, times: np.ndarray) -> None:
        """Numbers d of the points i (rising), each some times."""
        rows, at = np.unique(i, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(rows)), self.k), np.repeat(at, times)])
        d = np.concatenate([known[rows].ravel(), np.repeat(d, times)])
        order = np.lexsort((d, row))
        first = np.searchsorted(row[order], np.arange(len(rows)))
        known[rows] = d[order][first[:, None] + np.arange(self.k)]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences and not by products, so that they are the
    same whichever blocks two points are in."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d = x[:, i, None] - y[None, :, i]
        out += d * d
    return np.sqrt(out)


class Closest(Tile):
    """Of every point of a left block the nearest point so far: its distance and id."""

    def begin(self, fields, v):
        return np.full(len(v), np.inf), np.full(len(v), np.iinfo(np.int64).max)

    def end(self, fields, known):
        some = np.isfinite(known[0])
        return (fields[0][some], known[1][some], known[0][some]) if some.any() else None


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one product, and how far off its rounding may be."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = x @ y.T
    out *= -2.0
    out += xx[:, None]
    out += yy[None, :]
    return out, 1e-10 * (xx.max(initial=0.0) + yy.max(initial=0.0))


def measured(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``distances`` of the pairs (i, j)."""
    out = np.zeros(len(i))
    for k in range(x.shape[1]):
        d = x[i, k] - y[j, k]
        out += d * d
    return np.sqrt(out)


def within(x: np.ndarray, y: np.ndarray, radius, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d): the pairs of points within the radius (of all, or one for each point of x), in
    order, with their ``distances``; with ``least``, at least those that are among so many
    nearest ones of their point of x. One product finds what may be within it, with
    room for its rounding; those few are measured as in ``distances``."""
    about, room = squares(x, y)
    radius = np.broadcast_to(np.asarray(radius, dtype=np.float64), len(x))
    most = radius * radius + room
    maybe = about <= most[:, None]
    if least and 0 < least < len(y) and np.count_nonzero(maybe) > 4 * least * len(x):
        maybe = about <= np.minimum(most, np.partition(about, least - 1, axis=1)[:, least - 1] + 2 * room)[:, None]
    i, j = np.nonzero(maybe)
    d = measured(x, y, i, j)
    ok = d <= radius[i]
    return i[ok], j[ok], d[ok]


def are_within(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """``distances(x, y) <= radius``; only pairs too near to the radius for a product's rounding
    are measured."""
    over, room = squares(x, y)
    over -= radius * radius
    ok = over <= 0
    i, j = np.nonzero(np.abs(over) <= room)
    ok[i, j] = measured(x, y, i, j) <= radius
    return ok


def first_radius(pts: DataFrame, dims: int, work: float = 64.0, steps: int = 24) -> tuple[float, float]:
    """(radius, extent): the largest radius, halving from the extent of the points, at
    which the points of a cell number ``work`` on average, seen from a point."""
    d = pts.select(F.size("v")).first()
    if d is None:
        return 1.0, 0.0
    spans = pts.agg(*[(F.max(F.col("v")[i]) - F.min(F.col("v")[i])).alias(f"s{i}") for i in range(d[0])], F.count("*").alias("n")).first()
    extent = float(np.sqrt(sum(spans[f"s{i}"] ** 2 for i in range(d[0])))) * (1 + 1e-9)
    if extent == 0:
        return 1.0, 0.0
    rows = pts.select("v", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    side = F.lit(extent) * F.pow(F.lit(0.5), F.col("step"))
    keys = [F.floor(F.col("v")[i] / side).alias(f"c{i}") for i in range(dims)]
    load = rows.select("step", *keys).groupBy("step", *[f"c{i}" for i in range(dims)]).agg(F.count("*").alias("n"))
    load = load.groupBy("step").agg(F.sum(F.col("n") * F.col("n")).alias("work")).where(F.col("work") <= work * spans["n"])
    step = load.agg(F.min("step")).first()[0]
    return extent * 0.5 ** (steps if step is None else step), extent


def _radii(radius: float, extent: float, most: float | None) -> list[float]:
    """Radii that double, up to the first that reaches the extent or ``most``."""
    out = []
    while not out or not (out[-1] >= extent or (most is not None and out[-1] >= most)):
        r = radius * 2.0 ** len(out)
        out.append(r if most is None else min(r, most))
    return out


def core_distances(pts: DataFrame, k: int, dims: int, radius: float, extent: float, most: float | None = None):
    """(pid, core, round): distance to the k-th nearest point, the point counted itself and
    weights counted, and the number of the first radius that reaches it; and the
    list of radii, which double. Each point is compared only at radii at which
    it has fewer than k points around, and once more; where a radius settles hardly any
    point, the next ones are left out. Points with fewer than k within ``most`` have none."""
    steps = _radii(radius, extent, most)
    parts, left, n, j, skip = [], pts, pts.count(), 0, 1
    while True:
        r = steps[j]

        def nearest(x, vx, y, vy, same, known, task, r=r):
            i, j, d = within(vx, vy, np.minimum(known[:, -1], r), k)
            if len(i):
                task.add(known, i, d, np.minimum(y[0], k)[j])
        asked, all_ = blocks(left, r, dims, ["pid"]), blocks(pts, r, dims, ["weight"])
        near = met(block_pairs(asked, all_, dims), asked, all_, ["pid"], ["weight"], dims, nearest, "pid long, d array<double>", "near", lambda: Least(k))
        found = near.groupBy("pid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("d"))), 1, k).alias("d")).where(F.size("d") == k)
        found = stored(found.select("pid", F.element_at("d", k).alias("core")), "cores")
        parts.append(found)
        settled, asked_n = found.count(), n
        n -= settled
        if not n or j + 1 == len(steps):
            break
        if settled:
            left = stored(left.join(found.select("pid"), "pid", "left_anti"), "unsettled")
        skip = 2 * skip if settled < SOME * asked_n else 1
        j = min(j + skip, len(steps) - 1)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("round", F.size(F.filter(F.array(*[F.lit(x) for x in steps]), lambda x: x < F.col("core"))))
    if not n:
        steps = steps[:(out.agg(F.max("round")).first()[0] or 0) + 1]
    return out, steps


def nearest(asked: DataFrame, pts: DataFrame, dims: int, radius: float, extent: float, most: float | None = None) -> DataFrame:
    """(pid, near, d): for each asked vector (pid, v) the nearest point, ties by the smaller
    id, by radii that double: a vector that finds a point within a radius has the
    nearest, as all points within it were in the cells around. Vectors with none within
    ``most`` are absent."""
    steps = _radii(radius, extent, most)
    parts, left, n, j, skip = [], asked, asked.count(), 0, 1
    while True:
        r = steps[j]

        def least(x, vx, y, vy, same, known, task, r=r):
            i, at, d = within(vx, vy, np.minimum(known[0], r), 1)
            if not len(i):
                return
            order = np.lexsort((y[0][at], d, i))
            i, at, d = i[order], at[order], d[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            i, d, ids = i[first], d[first], y[0][at[first]]
            new = (d < known[0][i]) | ((d == known[0][i]) & (ids < known[1][i]))
            known[0][i[new]], known[1][i[new]] = d[new], ids[new]
        a, b = blocks(left, r, dims, ["pid"]), blocks(pts, r, dims, ["pid"])
        found = met(block_pairs(a, b, dims), a, b, ["pid"], ["pid"], dims, least, "pid long, near long, d double", "nearest", Closest)
        found = stored(found.groupBy("pid").agg(F.min(F.struct("d", "near")).alias("x")).select("pid", "x.near", "x.d"), "found")
        parts.append(found)
        settled, asked_n = found.count(), n
        n -= settled
        if not n or j + 1 == len(steps):
            break
        if settled:
            left = stored(left.join(found.select("pid"), "pid", "left_anti"), "unsettled")
        skip = 2 * skip if settled < SOME * asked_n else 1
        j = min(j + skip, len(steps) - 1)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dense_index(values: DataFrame, col: str, out: str = "idx", partitions: int | None = None) -> DataFrame:
    """(col, idx) with idx = 0.. in ``col`` order, computed distributed: a stored,
    range-partitioned table, whose rows are counted by partition."""
    d = values.select(col).distinct()
    n = partitions or d.sparkSession.sparkContext.defaultParallelism
    d = d.repartitionByRange(n, col).sortWithinPartitions(col).withColumn("_at", F.monotonically_increasing_id())
    d = stored(d, "ranged").withColumn("_p", F.shiftright("_at", 33))
    counts = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    offs = counts.select("_p", (before - F.col("_first")).alias("_o"))  # one row a partition
    return d.join(offs, "_p").select(col, (F.col("_at") + F.col("_o")).cast("int").alias(out))
