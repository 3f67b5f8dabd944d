"""Merkle manifest of a dataset, by time-forward processing.

Every row is a leaf: the digest of its columns' values, each written as ``-`` if null,
else byte count, ``:`` and value. Leaves of a group (a source) ascend by id; runs of
three consecutive nodes are hashed together until one node remains, the group's
subroot; the subroots, in order of group, make the root in the same way. A leaf's
proof is its siblings' digests, level by level, and folds the leaf up to the root.

Nodes are labelled in the order of time: all nodes of a level, then those of the next.

* Forward sweep: nodes are visited by rising label; an ordered queue holds each child's
  digest under the label of its parent, so that a parent finds its children's digests
  at the front of the queue just when its time comes.
* Reversed sweep: by falling label; every node finds its proof's rest at the front, and
  sends each child the child's siblings followed by that rest.

The queue is external: within a block (3^8 consecutive nodes and what is above them,
up to the block's top) it is a heap in one task's memory; between blocks messages are
rows of a shuffled table, keyed by the block that receives them, so that tops arrive in
the blocks of the next tier and proofs' rests in those of the tier below. A group's
blocks are spread over all tasks, however large it is, and the number of tiers is the
logarithm to the base 6,561 of its rows. Places of leaves are counted in a stored table
that is range-partitioned by (group, id): a row's place is its number in the
partition plus what earlier partitions hold of its group.

``given`` are the leaves as they are found when the manifest is checked (here: of
tampered texts). Their fold with the original siblings is compared with the root.

Rows: a null group is a group of its own and the first (order is by UTF-8 bytes); null
ids come before others, rows of equal group and id in order of their leaves, so that
repeated rows are leaves each; a null column counts as ``-`` and an empty text as
``0:``; an empty table gives no rows and has no root; further columns are not read. A
text is hashed in one pass of its row, whatever its length.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

ARITY, BLOCK = 3, 3 ** 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def written(value: Column) -> Column:
    """A value as it enters a leaf's digest."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[written(v) for v in values]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Tree:
    """Labels of the nodes over n leaves, up to a level or else to a single node."""

    def __init__(self, n: int, levels: int | None = None):
        self.sizes, self.first = [n], [0, n]
        while len(self.sizes) <= levels if levels is not None else self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // ARITY))
            self.first.append(self.first[-1] + self.sizes[-1])
        self.end = self.first[-1]  # the top's label is the last

    def forward(self, leaves: list[str]) -> list[str]:
        """Digests of all nodes by label."""
        queue: list[tuple[int, int, str]] = []
        out = list(leaves)
        for level in range(len(self.sizes)):
            for label in range(self.first[level], self.first[level + 1]):
                if level:
                    parts = []
                    while queue and queue[0][0] == label:
                        parts.append(heapq.heappop(queue)[2])
                    out.append(_hash("".join(parts)))
                if label < self.end - 1:
                    heapq.heappush(queue, (self.first[level + 1] + (label - self.first[level]) // ARITY, label, out[label]))
        return out

    def backward(self, digests: list[str], rest: tuple | None) -> list[tuple | None]:
        """Proof of each leaf, (left siblings, right siblings, rest of the proof), given
        the rest of the top's."""
        queue: list[tuple[int, tuple | None]] = [(1 - self.end, rest)]
        out: list[tuple | None] = [None] * self.sizes[0]
        for level in range(len(self.sizes) - 1, -1, -1):
            for label in range(self.first[level + 1] - 1, self.first[level] - 1, -1):
                proof = heapq.heappop(queue)[1]
                if not level:
                    out[label] = proof
                    continue
                a = self.first[level - 1] + (label - self.first[level]) * ARITY
                run = range(a, min(a + ARITY, self.first[level]))
                for child in run:
                    left, right = ("".join(digests[x] for x in side) for side in (range(a, child), range(child + 1, run.stop)))
                    heapq.heappush(queue, (-child, (left, right, proof)))
        return out


def chain(left: list[str], right: list[str]) -> tuple | None:
    """A proof from the lists of its levels' siblings, lowest level first."""
    proof = None
    for sides in zip(reversed(left), reversed(right)):
        proof = (*sides, proof)
    return proof


def links(proof: tuple | None):
    while proof is not None:
        yield proof[0], proof[1]
        proof = proof[2]


def folded(digest: str, proof: tuple | None) -> str:
    for left, right in links(proof):
        digest = _hash(left + digest + right)
    return digest


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with ``place``, their number from 0 in their group ``grp``, and ``total``, its size."""
    rows = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id())
    rows = C.store(rows, "sorted").withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    runs = C.store(runs.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total")), "runs")
    return rows.join(runs, ["grp", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _blocks(nodes: DataFrame, extra: list[str], block: int) -> DataFrame:
    """One row a block: its nodes' digests (and further columns) in order, and its top."""
    levels = next(k for k in range(64) if ARITY ** k >= block)
    rows = (nodes.groupBy("grp", F.expr(f"place DIV {block}").alias("block"))
            .agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("place", "digest", *extra))).alias("x"))
            .select("grp", "block", "total", *[F.col(f"x.{c}").alias(c) for c in ("digest", *extra)]))
    kept = rows.columns

    def run(batches):
        for b in batches:
            tops = [Tree(len(d), levels if total > block else None).forward(d)[-1]
                    for d, total in zip(b.column("digest").to_pylist(), b.column("total").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tops, pa.string())], [*kept, "top"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return C.store(rows.mapInArrow(run, fields + ", top string"), "blocks")


class Forest:
    """Trees over the nodes (grp, place, total, digest, further columns) of all groups."""

    def __init__(self, nodes: DataFrame, extra: list[str], block: int = BLOCK):
        self.block, self.levels = block, next(k for k in range(64) if ARITY ** k >= block)
        self.tiers = [_blocks(nodes, extra, block)]
        while not (more := self.tiers[-1].where(F.col("total") > block)).isEmpty():
            up = more.select("grp", F.col("block").alias("place"), F.expr(f"(total + {block - 1}) DIV {block}").alias("total"), F.col("top").alias("digest"))
            self.tiers.append(_blocks(up, [], block))

    def _whole(self, tier: DataFrame) -> DataFrame:
        return tier.where(F.col("total") <= self.block)

    def roots(self) -> DataFrame:
        """(grp, root)."""
        out = self._whole(self.tiers[0])
        for tier in self.tiers[1:]:
            out = out.unionByName(self._whole(tier), allowMissingColumns=True)
        return out.select("grp", F.col("top").alias("root"))

    def proofs(self, rests: DataFrame) -> DataFrame:
        """The first tier's blocks with the proofs' rests (left, right) of their tops, from
        those of the groups' roots: (grp, left, right)."""
        above = None
        for k in range(len(self.tiers) - 1, -1, -1):
            own = self._whole(self.tiers[k]).select("grp", "block").join(rests, "grp").select("grp", "block", "left", "right")
            tier = self.tiers[k].join(own if above is None else own.unionByName(above), ["grp", "block"])
            above = C.store(self._sent(tier), "rests") if k else None
        return tier

    def _sent(self, tier: DataFrame) -> DataFrame:
        """(grp, block, left, right): the proof of each node, for the block below it."""
        block, levels = self.block, self.levels

        def run(batches):
            kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
            for b in batches:
                for g, number, total, digests, left, right in zip(*(b.column(c).to_pylist() for c in ("grp", "block", "total", "digest", "left", "right"))):
                    tree = Tree(len(digests), levels if total > block else None)
                    sides = [list(links(p)) for p in tree.backward(tree.forward(digests), chain(left, right))]
                    cells = [[g] * len(sides), [number * block + i for i in range(len(sides))], *[[[s[k] for s in x] for x in sides] for k in (0, 1)]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cells, kinds)], ["grp", "block", "left", "right"])
        return tier.select("grp", "block", "total", "digest", "left", "right").mapInArrow(run, "grp string, block long, left array<string>, right array<string>")


def _checked(tier: DataFrame, root: str, levels: int, block: int) -> DataFrame:
    """The manifest's rows from the blocks of leaves with their subroots and proofs' rests."""
    def run(batches):
        for b in batches:
            for ids, leaves, given, subroot, total, left, right in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "given", "subroot", "total", "left", "right"))):
                tree = Tree(len(leaves), levels if total > block else None)
                proofs = tree.backward(tree.forward(leaves), chain(left, right))
                whole = [_hash("".join(a + z for a, z in links(p))) for p in proofs]
                found = [folded(g or d, p) for g, d, p in zip(given, leaves, proofs)]
                n = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(leaves), pa.array([subroot] * n), pa.array([root] * n), pa.array(whole), pa.array(found),
                     pa.array([x == root for x in found], pa.bool_())], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return tier.select("doc_id", "digest", "given", "subroot", "total", "left", "right").mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(leaves: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of the leaves
    (grp, doc_id, digest, given): grp text or null, given the leaf as it is found now
    (null: unchanged)."""
    order = F.concat(F.lit("+"), F.col("grp"))  # the null group is the empty text, which comes first
    rows = C.store(leaves.select(F.coalesce(order, F.lit("")).alias("grp"), "doc_id", "digest", "given", F.monotonically_increasing_id().alias("_row")), "leaves")
    forest = Forest(placed(rows, ["doc_id", "digest", "given", "_row"]).drop("_row"), ["doc_id", "given"], block)
    subroots = C.store(forest.roots(), "subroots")
    top = Forest(placed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("root").alias("digest")), ["member"]), ["member"], block)
    root = top.roots().first()
    root = root["root"] if root else ""
    none = F.array().cast("array<string>")
    ends = top.proofs(subroots.sparkSession.range(1).select(F.lit("").alias("grp"), none.alias("left"), none.alias("right")))
    rests = C.store(_members(ends, top.levels, block), "rests")
    whole = forest.proofs(rests).join(subroots.withColumnRenamed("root", "subroot"), "grp")
    return _checked(whole, root, forest.levels, block)


def _members(tier: DataFrame, levels: int, block: int) -> DataFrame:
    """(grp, left, right) of the top tree's leaves, which stand for the groups."""
    def run(batches):
        for b in batches:
            for members, digests, total, left, right in zip(*(b.column(c).to_pylist() for c in ("member", "digest", "total", "left", "right"))):
                tree = Tree(len(digests), levels if total > block else None)
                sides = [list(links(p)) for p in tree.backward(tree.forward(digests), chain(left, right))]
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.string()), *[pa.array([[s[k] for s in x] for x in sides], pa.list_(pa.string())) for k in (0, 1)]],
                                                 ["grp", "left", "right"])
    return tier.select("member", "digest", "total", "left", "right").mapInArrow(run, "grp string, left array<string>, right array<string>")


def tampered(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text is even; a null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def op11_merkle(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select(*COLUMNS)
    values = [F.col(c) for c in COLUMNS]
    changed = leaf(*values[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return manifest(docs.select(F.col("source").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf(*values).alias("digest"),
                                F.when(tampered(F.col("doc_id")) & (F.instr("text", "\n") > 0), changed).alias("given")))


def _written(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_LEAF = " || ".join(_written(c) for c in COLUMNS)
ORACLE = rf"""
WITH RECURSIVE
k AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS k),
l AS MATERIALIZED (SELECT doc_id, source, sha256({_LEAF}) AS leaf,
    CASE WHEN xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                              lambda c, x: xor(c // 256, k[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 2 = 0
         THEN sha256({_LEAF.replace("text::", "replace(text, chr(10), '')::")}) END AS given FROM documents, k),
s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf, given) AS r,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, given) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
t(g, lv, i, d, n) AS (SELECT source, 0, i, leaf, n FROM s
  UNION ALL SELECT g, lv + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY g, lv, i // 3),
r AS MATERIALIZED (SELECT g, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lv, i, d, n) AS (SELECT 0, i, d, n FROM r
  UNION ALL SELECT lv + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY lv, i // 3),
p AS MATERIALIZED (
  SELECT s.r, 0 AS tree, a.lv, string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i) AS lhs, string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i) AS rhs
  FROM s JOIN t a ON a.g IS NOT DISTINCT FROM s.source AND a.n > 1 AND a.i = s.i // CAST(pow(3, a.lv) AS BIGINT)
  JOIN t b ON b.g IS NOT DISTINCT FROM a.g AND b.lv = a.lv AND b.i // 3 = a.i // 3 GROUP BY ALL
  UNION ALL
  SELECT s.r, 1, a.lv, string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i)
  FROM s JOIN r ON r.g IS NOT DISTINCT FROM s.source JOIN u a ON a.n > 1 AND a.i = r.i // CAST(pow(3, a.lv) AS BIGINT)
  JOIN u b ON b.lv = a.lv AND b.i // 3 = a.i // 3 GROUP BY ALL),
q AS MATERIALIZED (SELECT r, coalesce(lhs, '') AS lhs, coalesce(rhs, '') AS rhs, row_number() OVER (PARTITION BY r ORDER BY tree, lv) AS k FROM p),
f(r, k, d) AS (SELECT r, 0::BIGINT, coalesce(given, leaf) FROM s UNION ALL SELECT f.r, q.k, sha256(q.lhs || f.d || q.rhs) FROM f JOIN q ON q.r = f.r AND q.k = f.k + 1),
w AS (SELECT r, sha256(string_agg(lhs || rhs, '' ORDER BY k)) AS proof FROM q GROUP BY r),
z AS (SELECT r, arg_max(d, k) AS d FROM f GROUP BY r)
SELECT s.doc_id, s.leaf, r.d AS subroot, (SELECT d FROM u WHERE n = 1) AS root, coalesce(w.proof, sha256('')) AS proof_sha256, z.d AS folded_root,
  z.d = (SELECT d FROM u WHERE n = 1) AS verified
FROM s JOIN r ON r.g IS NOT DISTINCT FROM s.source LEFT JOIN w USING (r) JOIN z USING (r)
"""
