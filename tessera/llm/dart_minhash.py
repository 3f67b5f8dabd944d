"""Near-duplicate documents by DartMinHash.

Elements are the distinct five-word shingles of a text, each with weight 1, so
that bands follow the similarity that decides (``weighted`` gives them the weight
1 + log2(occurrences); texts that repeat shingles then meet less often than their
sets are similar). Every element owns a region [0, weight) × [0, ∞) of
(weight, rank). Darts fall on it as a Poisson process of rate one that depends
on the element alone: the weight axis is cut into strips [0,1), [1,2), [2,4), …,
a strip's darts come in order of rank with exponential gaps, and each dart has a
hashed place in the strip, a hashed coordinate and an identity. A text keeps, of
the darts inside its regions, the earliest of each coordinate. Darts are thrown
up to a rank at which about ``k (ln k + 2)`` are expected; a text that leaves a
coordinate empty goes on at twice the rank. Two texts agree in a coordinate with
a probability equal to their weighted Jaccard similarity, which is the set
similarity with weights of 1.

150 coordinates make 30 bands of 5. At set similarity 0.8 a pair misses every band
with probability 7e-6, also where texts repeat shingles. Candidates are then checked exactly: the set Jaccard
similarity of the shingles must be 0.8 or more. Shingle sets are moved only for pairs whose
sketches (one byte of each coordinate) agree often enough; a pair at the threshold agrees
less often with a probability of MISS at most, far below that of the bands.

* Texts with the same shingle set are one class member from the start (one
  aggregation); only representatives enter the bands.
* In a bucket (equal band), members are compared with a pivot of the bucket, the
  member with the most rows in shared buckets, and not with one another. Verified
  pairs join their components. First come the buckets of five bands, then those of
  all bands in which several components are left; members of the pivot's component
  need no comparison. A large group of copies so costs a few comparisons a member.
* Buckets that still hold several components are mostly texts that share a passage,
  or variants of one text that are similar to it only. In buckets of at most MANY members
  the sketches of those of a similar size are compared, and their sets if most sketches
  agree. The members of larger ones go to
  new buckets, once for all of theirs: with all shingles in one order, two similar texts
  share one of the first |x| - 0.8 |x| + 1 of each (prefix filter). Shingles that a pivot
  holds come last, so a shared passage makes no bucket unless it is most of a text.
* New buckets that are still large and of several components are texts of one family, near
  the threshold from one another. They are dealt into blocks; two blocks at a time are
  compared like a bucket of MANY members. Blocks of the bucket's main component meet only
  those of others, so a large group of copies costs its size times the few other blocks;
  only many components in one such bucket cost their number's square, in bounded tasks.
  So no link between two members is lost, and no bucket is paired with itself as rows.

Rows: null text has no words; texts without words have the same (empty) shingle
set and form one class; a text of one to four words has its words as its one
shingle; a null doc_id is never a class id unless the class has no other; rows
that repeat a doc_id are members like others; an empty table gives none; further
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import common as C
from .bits import bit_filter

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 5
FEW, MANY = 32, 2048  # members of a key that make pairs, or are compared in one task
HELD, PAIRS = 1 << 21, 4  # shingles of a key in one task; pairs a member that it hands on
SLICE_BYTES = 1 << 18
MISS = 1e-7  # chance that a similar pair's sketches agree too rarely

_GOLD, _ALL = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def darts(element: np.ndarray, weight: np.ndarray, limit: np.ndarray):
    """(index of the element, rank, identity) of the darts that fall into the
    elements' regions below the rank limits."""
    found = []
    strip = 0
    who = np.arange(len(element))
    while len(who):
        low, high = (0.0, 1.0) if strip == 0 else (2.0 ** (strip - 1), 2.0 ** strip)
        who = who[weight[who] > low]
        seed = C.mix(element[who] + np.uint64((int(_GOLD) * (strip + 1)) & _ALL))
        rank = np.zeros(len(who))
        live, n = who, 0
        while len(live):
            n += 1
            dart = C.mix(seed + np.uint64((int(_GOLD) * n) & _ALL))
            rank = rank - np.log(_unit(dart)) / (high - low)
            ok = rank < limit[live]
            live, seed, rank, dart = live[ok], seed[ok], rank[ok], dart[ok]
            place = low + (high - low) * _unit(C.mix(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            inside = place <= weight[live]
            found.append((live[inside], rank[inside], dart[inside]))
        strip += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """n_rows × k identities of earliest darts. Rows without elements stay 0."""
    out = np.zeros((n_rows, k), dtype=np.uint64)
    total = np.bincount(row, weights=weight, minlength=n_rows)
    limit = np.divide(k * (np.log(k) + 2.0), total, out=np.zeros(n_rows), where=total > 0)
    todo = total > 0
    while todo.any():
        pick = todo[row]
        i, rank, dart = darts(element[pick], weight[pick], limit[row[pick]])
        cell = row[pick][i] * k + (C.mix(dart + _GOLD) % np.uint64(k)).astype(np.int64)
        by = np.argsort(-rank, kind="stable")  # the earliest is written last
        flat = np.zeros(n_rows * k, dtype=np.uint64)
        filled = np.zeros(n_rows * k, dtype=bool)
        flat[cell[by]] = dart[by]
        filled[cell] = True
        full = todo & filled.reshape(n_rows, k).all(axis=1)
        out[full] = flat.reshape(n_rows, k)[full]
        todo &= ~full
        limit = limit * 2.0
    return out


def _shingles(data: np.ndarray, offs: np.ndarray, roll: C.Rolling, size: int):
    """Distinct shingles as (row, hash, occurrences), sorted by row and hash."""
    starts, ends, at = C.words(data, offs)
    h = roll.words(data, starts, ends)
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    first = np.concatenate([[0], np.cumsum(count)])
    a = np.arange(len(row)) - first[row] + at[row]
    h = roll.ranges(h, a, np.minimum(a + size, at[row + 1]))
    by = np.lexsort((h, row))
    row, h = row[by], h[by]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][:len(h)])
    return row[new], h[new], np.diff(np.r_[new, len(h)])


def band_keys(docs: DataFrame, size: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """(_row, doc_id, n, same, bands, sketch): size and fingerprint of the shingle set, one
    key a band, and one byte of every coordinate."""
    def run(batches):
        roll = C.Rolling(1)
        for part, data, offs in C.text_slices(batches, size=SLICE_BYTES):
            row, h, times = _shingles(data, offs, roll, size)
            n = part.num_rows
            weight = 1.0 + np.log2(times) if weighted else np.ones(len(times))
            sig = signatures(row, h, weight, n, bands * rows)
            key = np.zeros((n, bands), dtype=np.uint64)
            for j in range(rows):
                key = C.mix(key * np.uint64(31) + sig[:, j::rows])
            key = C.mix(key + np.arange(bands, dtype=np.uint64) * _GOLD)
            edge = np.searchsorted(row, np.arange(n + 1))
            same = [xxhash.xxh3_128_digest(h[a:b].tobytes()) for a, b in zip(edge, edge[1:])]
            lists = pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), pa.array(key.ravel().astype(np.int64)))
            sketch = pa.array([line.tobytes() for line in sig.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("doc_id"), pa.array(np.diff(edge)), pa.array(same, pa.binary()), lists, sketch],
                                             ["_row", "doc_id", "n", "same", "bands", "sketch"])
    return docs.mapInArrow(run, "_row long, doc_id long, n long, same binary, bands array<long>, sketch binary")


def least_agreeing(k: int, threshold: float) -> int:
    """The largest number of coordinates, of k, that two texts at the threshold or above
    reach but for a probability of MISS."""
    below = 0.0
    for m in range(k + 1):
        below += math.comb(k, m) * threshold ** m * (1.0 - threshold) ** (k - m)
        if below > MISS:
            return m
    return k


def _agreeing(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose sketches agree in ``least`` coordinates or more."""
    def run(batches):
        for batch in batches:
            x, y = (C.raw_text(batch.column(c))[0].reshape(batch.num_rows, -1) for c in ("ka", "kb"))
            ok = np.flatnonzero((x == y).sum(axis=1) >= least) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(ok)) for c in ("a", "b")], ["a", "b"])
    side = lambda x: sketches.select(F.col("_row").alias(x), F.col("sketch").alias("k" + x))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long")


def _shingle_sets(docs: DataFrame, wanted, size: int) -> DataFrame:
    """(_row, set): sorted shingle hashes of the rows that the filter lets through."""
    def run(batches):
        roll = C.Rolling(1)
        passed = (b.filter(pa.array(wanted.has(C.mix(b.column("_row").to_numpy()).astype(np.int64)))) for b in batches)
        for part, data, offs in C.text_slices(passed, size=SLICE_BYTES):
            row, h, _ = _shingles(data, offs, roll, size)
            edge = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array([h[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())], ["_row", "set"])
    return docs.select("_row", "text").mapInArrow(run, "_row long, set binary")


def _compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with ``linked``, whether the Jaccard similarity of their sets is the
    threshold or more."""
    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                both = np.concatenate([np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y)])
                both.sort(kind="stable")
                n = int((both[1:] == both[:-1]).sum())
                linked.append(n >= threshold * (len(both) - n))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])
    return (pairs.join(sets.select(F.col("_row").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("_row").alias("b"), F.col("set").alias("sb")), "b")
            .select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, linked boolean"))


def _agreeing_in_key(threshold: float, least: int):
    """The pairs (a, b) of a key's members, of different components and similar sizes, whose
    sketches agree in ``least`` coordinates or more. Where these are more than PAIRS a
    member, one row (key, null) instead: then the sets themselves are looked at."""
    def run(table):
        rows = table.combine_chunks().to_batches()[0]
        row, comp, n = (rows.column(c).to_numpy() for c in ("_row", "comp", "n"))
        sketch = C.raw_text(rows.column("sketch"))[0].reshape(len(row), -1)
        found, total = [], 0
        for i in range(len(row) - 1):
            x = slice(i + 1, None)
            fits = (comp[x] != comp[i]) & (np.minimum(n[x], n[i]) >= threshold * np.maximum(n[x], n[i]))
            j = i + 1 + np.flatnonzero(fits)
            j = j[(sketch[j] == sketch[i]).sum(axis=1) >= least]
            found.append((np.full(len(j), row[i]), row[j]))
            total += len(j)
            if total > PAIRS * len(row):
                return pa.table({"a": rows.column("key").slice(0, 1), "b": pa.nulls(1, pa.int64())})
        a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*found) if found else ((), ())))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return run


def _linked_in_key(threshold: float):
    """Links (a, b) between a key's members whose sets are similar, as many as join their
    components: all sets of the key are counted against one after the other."""
    def run(table):
        rows = table.combine_chunks().to_batches()[0]
        row, comp, n = (rows.column(c).to_numpy() for c in ("_row", "comp", "n"))
        flat = np.frombuffer(b"".join(v.as_py() for v in rows.column("set")), dtype=np.uint64)
        first = np.cumsum(n) - n
        kinds, at = np.unique(flat, return_inverse=True)
        label = np.unique(comp, return_inverse=True)[1]
        held, found = np.zeros(len(kinds), dtype=bool), []
        for i in range(len(row)):
            mine = at[first[i]:first[i] + n[i]]
            held[mine] = True
            common = np.add.reduceat(held[at], first)
            held[mine] = False
            similar = common >= threshold * (n + n[i] - common)
            for j in np.flatnonzero(similar & (label != label[i])):
                if label[j] != label[i]:
                    found.append((row[i], row[j]))
                    label[label == label[j]] = label[i]
        a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return run


class _Linker:
    """Verified links between rows, and the components that they make so far."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, threshold: float, sketches: DataFrame | None = None, least: int = 0):
        self.sets, self.threshold, self.links = sets, threshold, None
        self.sketches, self.least = sketches, least
        self.comps = nodes.select("_row", F.col("_row").alias("comp"))

    def open(self, members: DataFrame) -> DataFrame:
        """Members (key, _row, weight, n) of the keys that hold several components, with
        these. Keys with the same members become one."""
        now = C.store(members.join(self.comps, "_row"), "members")
        several = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.xxhash64(
            F.count("*"), F.bit_xor(F.xxhash64("_row")), F.bit_xor(F.xxhash64("_row", F.lit(1)))).alias("same")).where("lo < hi").select("key", "same")
        return C.store(now.join(several, "key").select(F.col("same").alias("key"), "_row", "weight", "n", "comp").distinct(), "open")

    def pairs(self, members: DataFrame) -> DataFrame:
        """Members (key, a, ca, na, weight) with the heaviest member (b, cb, nb) of their key."""
        own = F.struct("_row", "comp", "n")
        pivots = C.store(members.groupBy("key").agg(F.min_by(own, F.struct(-F.col("weight"), "_row")).alias("p")), "pivots")
        return members.join(pivots, "key").select("key", F.col("_row").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), "weight",
                                                  F.col("p._row").alias("b"), F.col("p.comp").alias("cb"), F.col("p.n").alias("nb"))

    def add(self, found: DataFrame) -> None:
        found = found.select("a", "b")
        self.links = found if self.links is None else self.links.union(found)
        at = lambda x: self.comps.select(F.col("_row").alias(x), F.col("comp").alias("c" + x))
        joins = C.store(found.join(at("a"), "a").join(at("b"), "b").where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "joins")
        if joins.isEmpty():
            return
        moved = connected_components(joins.select(F.col("a").alias("id")).union(joins.select("b")), joins)
        self.comps = C.store(self.comps.join(moved.select(F.col("id").alias("comp"), F.col("comp").alias("new")), "comp", "left")
                             .select("_row", F.coalesce("new", "comp").alias("comp")), "comps")

    def compare(self, pairs: DataFrame) -> None:
        pairs = pairs.distinct()
        if self.sketches is not None:
            pairs = C.store(_agreeing(pairs, self.sketches, self.least), "agreeing")
        self.add(C.store(_compared(pairs, self.sets, self.threshold), "compared").where("linked"))

    def sweep(self, members: DataFrame) -> None:
        """Compare the members of each key with its pivot."""
        fits = (F.col("ca") != F.col("cb")) & (F.least("na", "nb") >= F.lit(self.threshold) * F.greatest("na", "nb"))
        self.compare(self.pairs(self.open(members)).where(fits).select("a", "b"))

    def small(self, live: DataFrame, blocks: bool = False) -> DataFrame:
        """Compare the members of keys with MANY members at most with one another, by their
        sketches first; the others are left (of ``blocks`` none). Keys of up to FEW make
        pairs, larger ones are compared in one task a key."""
        size = live.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("held"))
        if not blocks:
            size = size.where((F.col("size") <= FEW) | (F.col("size") <= MANY) & (F.col("held") <= HELD))
        sizes = C.store(size.select("key", "size"), "sizes")
        small = C.store(live.join(sizes, "key").select("key", "_row", "comp", "n", "size"), "small")
        few = small.where(F.col("size") <= FEW).drop("size")
        other = few.select("key", F.col("_row").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"))
        fits = (F.col("_row") < F.col("b")) & (F.col("comp") != F.col("cb")) & (F.least("n", "nb") >= F.lit(self.threshold) * F.greatest("n", "nb"))
        pairs = few.join(other, "key").where(fits).select(F.col("_row").alias("a"), "b")
        more = small.where(F.col("size") > FEW).drop("size")
        dense = more.select("key").distinct()
        if self.sketches is not None:
            close = C.store(more.join(self.sketches, "_row").groupBy("key").applyInArrow(_agreeing_in_key(self.threshold, self.least), "a long, b long"), "close")
            pairs = pairs.union(close.where("b IS NOT NULL"))
            dense = close.where("b IS NULL").select(F.col("a").alias("key"))
        self.compare(pairs)
        whole = more.join(dense, "key", "left_semi").join(self.sets, "_row")
        self.add(C.store(whole.groupBy("key").applyInArrow(_linked_in_key(self.threshold), "a long, b long").distinct(), "linked"))
        return live.join(sizes, "key", "left_anti").select(live.columns)

    def blocks(self, large: DataFrame) -> DataFrame:
        """Members of new keys, each of two blocks of a key's members: blocks of its main
        component with those of the others, and the others' with one another."""
        per = large.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("held"))
        per = per.groupBy("key").agg(F.max_by(F.struct("comp", "rows", "held"), F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("rows"), F.sum("held").alias("held"))
        count = lambda rows, held: F.greatest(F.ceil(rows / F.lit(MANY / 3)), F.ceil(held / F.lit(HELD / 3)))
        per = C.store(per.select("key", F.col("main.comp").alias("main"), count(F.col("main.rows"), F.col("main.held")).alias("mains"),
                                 count(F.col("rows") - F.col("main.rows"), F.col("held") - F.col("main.held")).alias("others")), "block_counts")
        rows = large.join(per, "key").withColumn("of_main", F.col("comp") == F.col("main"))
        block = F.pmod(F.xxhash64("_row"), F.when(F.col("of_main"), F.col("mains")).otherwise(F.col("others")))
        rows = rows.withColumn("block", block)
        each = lambda n, other: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), other)
        with_main = F.when(F.col("of_main"), each(F.col("others"), lambda i: F.xxhash64("key", F.lit("main"), F.col("block"), i))).otherwise(
            each(F.col("mains"), lambda i: F.xxhash64("key", F.lit("main"), i, F.col("block"))))
        with_others = F.when(F.col("of_main"), F.array().cast("array<long>")).otherwise(
            each(F.col("others"), lambda i: F.xxhash64("key", F.lit("others"), F.least(i, F.col("block")), F.greatest(i, F.col("block")))))
        return rows.withColumn("keys", F.concat(with_main, with_others)).select(F.explode_outer("keys").alias("key"), "_row", "weight", "n", "comp")

    def first_shingles(self, large: DataFrame) -> DataFrame:
        """Members (key, _row, weight, n) of new keys, for the members of all keys of
        ``large``: a key is a shingle among the first ones of two sets. Shingles of the
        old keys' pivots come last in the order, others by hash."""
        pivots = large.groupBy("key").agg(F.min_by("_row", F.struct(-F.col("weight"), "_row")).alias("_row")).select("_row").distinct()
        held = C.store(_flat_sets(self.sets.join(C.store(pivots, "pivots"), "_row", "left_semi")).distinct(), "held")
        hot = C.store(large.groupBy("_row").agg(F.max("weight").alias("weight"), F.max("n").alias("n")), "hot")
        first = C.store(_prefixes(self.sets.join(hot, "_row"), bit_filter(held, "h", held.count()), self.threshold), "prefixes")
        twice = first.select(F.explode_outer("first").alias("h")).groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
        twice = C.store(twice, "twice")
        return _by_shingle(first, bit_filter(twice, "h", twice.count()))

    def finish(self, members: DataFrame) -> None:
        """Compare the members of small keys with one another, those of large ones by
        their first shingles, and where these still make large keys, by blocks."""
        live = self.open(members)
        for step in (self.first_shingles, None):
            if live.isEmpty():
                return
            large = C.store(self.small(live), "large")
            if large.isEmpty():
                return
            live = self.open(large.drop("comp") if step is None else step(large))
        if not live.isEmpty():
            self.small(C.store(self.blocks(live), "blocks"), True)


def _flat_sets(sets: DataFrame) -> DataFrame:
    """(h): the shingles of all sets."""
    def run(batches):
        for b in batches:
            data = b"".join(v.as_py() for v in b.column("set"))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(data, dtype=np.int64)))], ["h"])
    return sets.select("set").mapInArrow(run, "h long")


def _prefixes(sets: DataFrame, late, threshold: float) -> DataFrame:
    """(_row, weight, n, first): the first shingles of each set, as many as make similar
    sets share one; those that the filter holds come last."""
    def run(batches):
        for b in batches:
            lists = []
            for v in b.column("set"):
                h = np.frombuffer(v.as_buffer(), dtype=np.int64)
                last = late.has(h)
                n = len(h) - int(np.ceil(threshold * len(h) - 1e-9)) + 1
                lists.append(np.concatenate([h[~last], h[last]])[:n])
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *lists]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("_row", "weight", "n")], pa.ListArray.from_arrays(pa.array(at), flat)], ["_row", "weight", "n", "first"])
    return sets.select("_row", "weight", "n", "set").mapInArrow(run, "_row long, weight long, n long, first array<long>")


def _by_shingle(rows: DataFrame, wanted) -> DataFrame:
    """(key, _row, weight, n): every row (_row, weight, n, first) under each of its first
    shingles that the filter lets through."""
    def run(batches):
        for b in batches:
            lists = b.column("first")
            of, key = C.row_of(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            ok = wanted.has(key)
            of = pa.array(of[ok])
            yield pa.RecordBatch.from_arrays([pa.array(key[ok]), *[b.column(c).take(of) for c in ("_row", "weight", "n")]], ["key", "_row", "weight", "n"])
    return rows.mapInArrow(run, "key long, _row long, weight long, n long")


def _link(members: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, first_bands: int = 5,
          sketches: DataFrame | None = None, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and components (_row, comp) of members (band, key, _row, weight, n)."""
    linker = _Linker(nodes, sets, threshold, sketches, least)
    linker.sweep(members.where(F.col("band") < first_bands).drop("band"))
    linker.sweep(members.drop("band"))
    linker.finish(members.drop("band"))
    return linker.links, linker.comps


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
               weighted: bool = False) -> DataFrame:
    """One row per document: _row, doc_id, class_id (smallest doc_id of its class),
    class_size, n_links (verified links of its representative), kept."""
    return near_rows(C.identified_text(docs), shingle, threshold, bands, rows, weighted)


def near_rows(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
              weighted: bool = False) -> DataFrame:
    """near_dedup of stored rows (_row, doc_id, text)."""
    keyed = C.store(band_keys(docs, shingle, bands, rows, weighted), "bands")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    reps = C.store(keyed.groupBy("same").agg(F.min(order).alias("rep"), F.count("*").alias("copies"))
                   .select("same", F.col("rep.row").alias("rep"), "rep.none", "rep.id", "copies"), "reps")
    banded = keyed.join(reps.select(F.col("rep").alias("_row")), "_row", "left_semi").select("_row", "n", F.posexplode("bands").alias("band", "key"))
    banded = C.store(banded, "banded")
    shared = C.store(banded.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "shared")
    members = C.store(banded.join(shared, "key"), "shared_members")
    weight = members.groupBy("_row").agg(F.sum("times").alias("weight"))
    members = C.store(members.drop("times").join(weight, "_row"), "bucketed")
    nodes = C.store(members.select("_row").distinct(), "nodes")
    mixed = nodes.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array(C.mix(b.column(0).to_numpy()).astype(np.int64))], ["h"]) for b in it), "h long")
    sets = C.store(_shingle_sets(docs, bit_filter(mixed, "h", nodes.count()), shingle).join(nodes, "_row", "left_semi"), "sets")
    # the sketches of weighted signatures say nothing about the sets' similarity
    sketches = None if weighted else C.store(keyed.select("_row", "sketch").join(nodes, "_row", "left_semi"), "sketches")
    links, comps = _link(members, nodes, sets, threshold, sketches=sketches, least=least_agreeing(bands * rows, threshold))
    links = C.store(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links"))
    classed = C.store(reps.join(comps.withColumnsRenamed({"_row": "rep", "comp": "class"}), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
                      .join(degree, "rep", "left"), "classed")
    best = F.struct(F.col("none"), F.col("id"), F.col("rep").alias("row"))
    classes = C.store(classed.groupBy("class").agg(F.min(best).alias("best"), F.sum("copies").alias("class_size"))
                      .select("class", F.col("best.id").alias("class_id"), F.col("best.row").alias("keep_row"), "class_size"), "classes")
    by_set = C.store(classed.select("same", "class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")).join(classes, "class"), "by_set")
    return keyed.select("_row", "doc_id", "same").join(by_set, "same").select(
        "_row", "doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"), "n_links", (F.col("_row") == F.col("keep_row")).alias("kept"))


def op1_dart_minhash(spark, sf_dir):
    return near_dedup(C.table(spark, sf_dir, "documents")).drop("_row")
