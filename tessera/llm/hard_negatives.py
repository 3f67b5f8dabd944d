"""Hard negatives by Kronecker-packed products.

A row's score against an anchor is the inner product of their integer vectors.
Of several candidates, the biased (so non-negative) components of one dimension
are packed into separate fields of one wide integer, c_1 + c_2 2^F + c_3 2^2F + …
One multiplication by the anchor's biased component multiplies them all, and the
sum over dimensions leaves each candidate's inner product in its own field, as no
field can overflow into the next. Taking off the bias gives the exact scores:

    sum (a + A)(c + B) = sum a c + B sum (a + A) + A sum (c + B) - d A B

The wide integers are carried in doubles, which are exact below 2^53, so that the
products of a block of anchors with a block of packed candidates are one matrix
product. Where one field needs more than 53 bits they are Python integers of any
width instead (scores beyond 64 bits are then returned as the nearest long).

* Candidates: equal ids become one row in one shuffle, and rows are dealt into
  blocks by the hash of their id. Blocks are a stored table, one row a block.
* Anchors are dealt by hash into chunks of about ``CHUNK`` rows, each broadcast to all
  blocks (CHUNK x d x 8 bytes); the number of chunks grows with the anchors.
* First pass: the best rows of the anchor's label in each block, then over all
  blocks. Second pass: with the positives' scores as windows, the first rows of
  other labels in each block, then over all blocks. Only those few rows of a block
  and anchor are shuffled, and no pair is ever a row.

Rows: a null id, label or vector and a null or non-finite component take no part;
of rows that repeat an id, the one with the smallest label, then vector, does; a
shorter vector is filled up with zeros, so an empty one scores 0 everywhere; ties
in score go by the smaller id; an anchor without other rows of its label, or a
positive without rows in its window, gives no row; an empty table gives none;
further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
LOW, HIGH = 80, 100  # per cent of the positive's score
BLOCK, CHUNK, ANCHORS_AT_ONCE = 8_192, 8_192, 256
_LONG = 1 << 63


class Packed:
    """Candidates of a block, their biased components packed along the rows."""

    def __init__(self, vectors: np.ndarray, reach: int):
        """vectors: n x d integers; reach: the largest absolute component of an anchor."""
        n, d = vectors.shape
        most = max((abs(int(x)) for x in (vectors.min(initial=0), vectors.max(initial=0))), default=0)
        self.n, self.d, self.a, self.b = n, d, int(reach), most
        self.width = max(1, (max(d, 1) * (2 * self.a) * (2 * self.b)).bit_length())
        self.fields = max(1, 53 // self.width)
        self.wide = object if self.width > 53 else np.float64
        if self.wide is object:
            self.fields = 4
        biased = vectors.astype(object if self.wide is object else np.int64) + self.b
        self.sums = biased.sum(axis=1) if d else np.zeros(n, dtype=biased.dtype)
        rows = -(-n // self.fields)
        lanes = np.zeros((rows * self.fields, d), dtype=biased.dtype)
        lanes[:n] = biased
        lanes = lanes.reshape(self.fields, rows, d)
        packed = lanes[0]
        for k in range(1, self.fields):
            packed = packed + lanes[k] * (1 << (k * self.width))
        self.packed = packed.astype(self.wide).T

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """anchors (m x d integers) x n exact inner products."""
        biased = anchors.astype(object if self.wide is object else np.int64) + self.a
        product = biased.astype(self.wide) @ self.packed
        if self.wide is not object:
            product = product.astype(np.int64)
        mask = (1 << self.width) - 1
        lanes = [(product >> (k * self.width)) & mask for k in range(self.fields)]
        own = biased.sum(axis=1) if self.d else np.zeros(len(anchors), dtype=biased.dtype)
        return np.concatenate(lanes, axis=1)[:, :self.n] - self.b * own[:, None] - self.a * self.sums[None, :] + self.d * self.a * self.b


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest allowed scores, ties by smaller id."""
    at = np.flatnonzero(allowed)
    if len(at) > n:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - n)[len(s) - n]]
    return at[np.lexsort((ids[at], -scores[at]))[:n]]


def _long(x) -> int:
    return max(-_LONG, min(_LONG - 1, int(x)))


def clean(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v as floor(scale * component)."""
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return (rows.select("vec_id", "label", "embedding").where(ok).where(F.coalesce(finite, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
            .groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"))


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    """Lists of longs as rows of d, filled up with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), d), dtype=np.int64)
    out[np.repeat(np.arange(len(lists)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def blocks(rows: DataFrame, d: int, n_blocks: int) -> DataFrame:
    """One row a block: the bytes of its ids, labels and vectors."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table.column("v").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        cells = [table.column("vec_id").to_numpy().astype(np.int64).tobytes(), table.column("label").to_numpy().astype(np.int64).tobytes(), _matrix(lists, d).tobytes()]
        return pa.table({"block": table.column("block").slice(0, 1), **{k: pa.array([v], pa.binary()) for k, v in zip(("ids", "labels", "vectors"), cells)}})
    return (rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
            .groupBy("block").applyInArrow(run, "block int, ids binary, labels binary, vectors binary"))


def _each_block(table: DataFrame, anchors: np.ndarray, reach: int, d: int, found, schema: str) -> DataFrame:
    """found(scores, ids, labels, first) for the anchors' scores against every block;
    ``first`` is the number of the first anchor. It gives lists of columns."""
    shared = table.sparkSession.sparkContext.broadcast(anchors)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for ids, labels, vectors in zip(*(batch.column(c) for c in ("ids", "labels", "vectors"))):
                ids, labels = (np.frombuffer(x.as_buffer(), dtype=np.int64) for x in (ids, labels))
                packed = Packed(np.frombuffer(vectors.as_buffer(), dtype=np.int64).reshape(len(ids), d), reach)
                for lo in range(0, len(shared.value), ANCHORS_AT_ONCE):
                    scores = packed.scores(shared.value[lo:lo + ANCHORS_AT_ONCE])
                    out = found(scores, ids, labels, lo)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)
    return table.select("ids", "labels", "vectors").mapInArrow(run, schema)


def _ranked(rows: DataFrame, keys: list[str], score: str, row: str, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(row)))
    return rows.withColumn("rank", place).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from
    (vec_id, label, v) with distinct ids. ``is_anchor``: a condition on these columns."""
    spark = rows.sparkSession
    rows = C.store(rows, "vectors")
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    d = about["d"] or 0
    table = C.store(blocks(rows, d, max(1, -(-about["n"] // block))), "blocks")
    pick = rows.where(is_anchor)
    n_chunks = max(1, -(-pick.count() // chunk))
    pick = C.store(pick.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_chunks))), "anchors")
    out = []
    for k in range(n_chunks):
        mine = pick.where(F.col("chunk") == k).select("vec_id", "label", "v").toArrow().sort_by("vec_id").combine_chunks()
        if not mine.num_rows:
            continue
        ids, own = (mine.column(c).to_numpy() for c in ("vec_id", "label"))
        vectors = _matrix(mine.column("v").chunk(0), d)
        reach = max(abs(int(vectors.min(initial=0))), abs(int(vectors.max(initial=0))))
        marks = spark.sparkContext.broadcast((ids, own))

        def same(scores, of, labels, lo):
            who, mates = marks.value
            cols = [[], [], []]
            for k in range(len(scores)):
                for i in best(scores[k], of, (labels == mates[lo + k]) & (of != who[lo + k]), positives):
                    for c, x in zip(cols, (who[lo + k], of[i], _long(scores[k, i]))):
                        c.append(x)
            return cols
        near = _ranked(_each_block(table, vectors, reach, d, same, "anchor_id long, positive_id long, positive_score long"),
                       ["anchor_id"], "positive_score", "positive_id", positives).drop("rank")
        near = C.store(near, "positives")
        # a few rows for each anchor of the chunk
        found = near.toArrow().sort_by([("anchor_id", "ascending"), ("positive_id", "ascending")])
        edge = np.searchsorted(found.column("anchor_id").to_numpy(), np.r_[ids, _LONG - 1])
        if len(edge) > 1:
            edge[-1] = found.num_rows
        windows = spark.sparkContext.broadcast((edge, found.column("positive_id").to_numpy(), found.column("positive_score").to_numpy()))

        def other(scores, of, labels, lo):
            who, mates = marks.value
            at, mate, level = windows.value
            cols = [[], [], [], [], []]
            for k in range(len(scores)):
                differs = labels != mates[lo + k]
                for j in range(at[lo + k], at[lo + k + 1]):
                    s = int(level[j])
                    # low * s <= 100 * score <= high * s, in whole numbers
                    inside = differs & (scores[k] >= -(-low * s // 100)) & (scores[k] <= high * s // 100)
                    for i in best(scores[k], of, inside, negatives):
                        for c, x in zip(cols, (who[lo + k], mate[j], of[i], s, _long(scores[k, i]))):
                            c.append(x)
            return cols
        rivals = _each_block(table, vectors, reach, d, other, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
        out.append(C.store(_ranked(rivals, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives), "negatives"))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir):
    rows = clean(C.table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id AS id, c.label AS label,
    CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
