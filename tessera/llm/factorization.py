"""Quality classifier: a factorisation machine.

A text's features are its hashed words (log counts, scaled to unit length) and
standardised statistics of its structure and size. The score is the logistic of
``w0 + Σ w_i x_i + Σ_{i<j} <v_i, v_j> x_i x_j``; the pairwise sum is computed in
linear time as ``½ Σ_f [(Σ_i v_if x_i)² − Σ_i v_if² x_i²]``.

Training takes a sample of labelled rows, bounded by ``max_rows``: those with the
smallest hash of their id. Their features come to the driver and the model is
fitted there by Adam. Scoring reads all whole texts in one pass without a
shuffle; the model (D × (k + 1) floats) has a fixed size. Labels, language,
source and id are no features.

Rows: null text is the empty text and gets a score like any other; a null id is
held in or out by the crc of the empty text and never matches a label; labels
that repeat an id count once, by their maximum, and null labels not at all;
texts that repeat an id train once. Without labelled rows, or with one class
only, every score is the smoothed share of good rows, (good + 1) / (all + 2). An
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .repetition import _dup_lines, _sums

BUCKETS, FACTORS, MAX_ROWS = 1 << 12, 8, 12_000
FOLDS, CUT = 5, 0.3


def _byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _byte_set(bytes(range(65, 91))), _byte_set(b"0123456789")
_LETTER = _byte_set(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_SYMBOL, _POINT = _byte_set(b"#*$%&|<>@^~=+_{}[]\\"), _byte_set(b".,;:!?")
N_STATS = 14


def features(data: np.ndarray, offs: np.ndarray, roll: C.Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, buckets, values) of the hashed words and the rows × N_STATS statistics."""
    low = C.lower_ascii(data)
    starts, ends, at = C.words(data, offs)
    n, n_rows = np.diff(at), len(offs) - 1
    row = C.row_of(at)
    h = roll.words(low, starts, ends)
    key, count = np.unique(row.astype(np.int64) * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    of, bucket = key // BUCKETS, key % BUCKETS
    edge = np.searchsorted(of, np.arange(n_rows + 1))
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(of, weights=value * value, minlength=n_rows))
    value = value / norm[of]
    chars = np.maximum(C.code_points(data, offs), 1)
    words = np.maximum(n, 1)
    letters = np.maximum(_sums(_LETTER[data], offs), 1)
    length = ends - starts
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    closed = np.zeros(len(h), dtype=bool)
    if len(h):
        closed = _POINT[data[ends - 1]]
    lines = _sums(data == 10, offs) + 1
    stats = np.column_stack([
        np.log1p(n), np.log1p(chars), _sums(length, at) / words, _sums(_UPPER[data], offs) / letters, _sums(_SYMBOL[data], offs) / chars,
        _sums(_DIGIT[data], offs) / chars, _sums(_POINT[data], offs) / chars, _sums(data == 33, offs) / words, np.log1p(n / lines),
        np.diff(edge) / words, _sums(again, at) / words, _dup_lines(data, offs, starts, roll) / lines, _sums(length <= 2, at) / words,
        _sums(closed, at) / words]).astype(np.float64)
    return edge, bucket, value, stats


@dataclass
class Machine:
    """Weights over BUCKETS hashed words and N_STATS statistics, in that order."""
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4.0, 4.0)

    def logits(self, edge: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        x = self.standard(stats)
        row, n = C.row_of(edge), len(edge) - 1
        out = self.w0 + np.bincount(row, weights=self.w[bucket] * value, minlength=n) + x @ self.w[BUCKETS:]
        for f in range(self.v.shape[1]):
            vx = self.v[bucket, f] * value
            dense = self.v[BUCKETS:, f]
            s = np.bincount(row, weights=vx, minlength=n) + x @ dense
            q = np.bincount(row, weights=vx * vx, minlength=n) + (x * x) @ (dense * dense)
            out += 0.5 * (s * s - q)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(edge: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, label: np.ndarray, factors: int = FACTORS,
        epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adam on the logistic loss, in batches."""
    good, n = int(label.sum()), len(label)
    prior = (good + 1) / (n + 2)
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(BUCKETS + N_STATS), np.zeros((BUCKETS + N_STATS, factors)), np.zeros(N_STATS), np.ones(N_STATS))
    if good in (0, n):
        return m
    m.mean, m.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    rng = np.random.default_rng(seed)
    m.v = rng.normal(0, 0.05, m.v.shape)
    dense_all = m.standard(stats)
    params = np.column_stack([m.w, m.v])
    first, second, step, bias = np.zeros_like(params), np.zeros_like(params), 0, np.zeros(2)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo:lo + batch]
            size = edge[rows + 1] - edge[rows]
            at = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(edge[rows], size)
            of, b, x, d = np.repeat(np.arange(len(rows)), size), bucket[take], value[take], dense_all[rows]
            w, v = params[:, 0], params[:, 1:]
            vx = v[b] * x[:, None]
            s = np.column_stack([np.bincount(of, weights=vx[:, f], minlength=len(rows)) for f in range(factors)]) + d @ v[BUCKETS:]
            q = np.bincount(of, weights=(vx * vx).sum(axis=1), minlength=len(rows)) + (d * d) @ (v[BUCKETS:] ** 2).sum(axis=1)
            z = m.w0 + np.bincount(of, weights=w[b] * x, minlength=len(rows)) + d @ w[BUCKETS:] + 0.5 * ((s * s).sum(axis=1) - q)
            g = (sigmoid(z) - label[rows]) / len(rows)
            grad = decay * params
            part = np.column_stack([g[of] * x, g[of, None] * (s[of] - vx) * x[:, None]])
            for f in range(factors + 1):
                grad[:BUCKETS, f] += np.bincount(b, weights=part[:, f], minlength=BUCKETS)
            grad[BUCKETS:, 0] += d.T @ g
            grad[BUCKETS:, 1:] += d.T @ (g[:, None] * s) - ((d * d).T @ g)[:, None] * v[BUCKETS:]
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            params = params - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
            bias = 0.9 * bias + 0.1 * np.array([g.sum(), 0])
            m.w0 -= rate * bias[0] / (1 - 0.9 ** step)
    m.w, m.v = np.ascontiguousarray(params[:, 0]), np.ascontiguousarray(params[:, 1:])
    return m


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold."""
    labelled = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
                .where((C.crc_mod("doc_id", FOLDS) != 0) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
                .groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("quality")))
    picked = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows × 12 bytes

    def run(batches):
        roll = C.Rolling(3)
        for rows, data, offs in C.text_slices(batches):
            edge, bucket, value, stats = features(data, offs, roll)
            at = edge.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("quality"), pa.ListArray.from_arrays(at, pa.array(bucket.astype(np.int32))),
                 pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32))),
                 pa.ListArray.from_arrays(np.arange(0, stats.size + 1, N_STATS, dtype=np.int32), pa.array(stats.ravel()))],
                ["doc_id", "quality", "bucket", "value", "stats"])
    found = (C.id_text(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
             .mapInArrow(run, "doc_id long, quality int, bucket array<int>, value array<float>, stats array<double>")
             .groupBy("doc_id").agg(F.min(F.struct("quality", "bucket", "value", "stats")).alias("x"))
             .select("doc_id", "x.*").toArrow().sort_by("doc_id").combine_chunks())
    if not found.num_rows:
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, N_STATS)), np.zeros(0))
    lists = {c: found.column(c).chunk(0) for c in ("bucket", "value", "stats")}
    edge = lists["bucket"].offsets.to_numpy().astype(np.int64)
    flat = lambda c: lists[c].flatten().to_numpy()
    return fit(edge - edge[0], flat("bucket"), flat("value").astype(np.float64), flat("stats").reshape(-1, N_STATS), found.column("quality").to_numpy().astype(np.float64))


def scores(machine: Machine, data: np.ndarray, offs: np.ndarray, roll: C.Rolling) -> np.ndarray:
    return sigmoid(machine.logits(*features(data, offs, roll)))


def classify(docs: DataFrame, machine: Machine, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    def run(batches):
        roll = C.Rolling(3)
        for rows, data, offs in C.text_slices(batches):
            p = scores(machine, data, offs, roll)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])
    return (C.id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
            .select("doc_id", (C.crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted"))


def accepted(docs: DataFrame, machine: Machine, cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, that are scored ``cut`` or more."""
    def run(batches):
        roll = C.Rolling(3)
        for rows, data, offs in C.text_slices(batches):
            yield rows.filter(pa.array(scores(machine, data, offs, roll) >= cut))
    return docs.mapInArrow(run, docs.schema)


def op3_factorization(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    return classify(docs, train(docs, C.table(spark, sf_dir, "labels")))
