"""Scoring texts with an n-gram model learnt from the corpus, as a weighted backoff
automaton.

States are the n-grams of up to ``order - 1`` tokens, the empty one being the root.
From state h, a token w that followed h in training is an arc of weight
log p(w | h); any other token takes the failure arc of h, of weight
log (mu / (c(h) + mu)), to the state without h's first token, and is tried there.
The root has an arc for every token, also unknown ones. With
``p(w | h) = (c(hw) + mu p(w | h')) / (c(h) + mu)`` (Dirichlet smoothing towards the
shorter context h') the weights of each state sum to one. A text is read once from
left to right, from the state "start of text" to the token "end", and its arc
weights add up.

The automaton is as large as the corpus and is never in one place. Texts are read
once, in slices of about a million tokens, each a stored row with its documents and
their token sequences; what belongs to a slice is so settled before any job counts in
it, however the files are packed into splits later. A slice sends the distinct n-grams
of its texts, with their training counts, to shards by hash: an n-gram leaves a slice
once however often it occurs there, so a token with a third of all occurrences is one
key a slice. A shard adds up its counts and answers every slice with the totals of its
keys, in their order. A second job meets the answers with the slices, which makes the
slice's own part of the automaton, and reads the texts through it. Shards are made for about 16 MB of text
each, so they don't grow with the corpus. Keys are 64-bit hashes.

Rows: null text is the empty text, which has the one token "end"; a null id is
held in or out by the crc of the empty text; rows that repeat an id are texts of
their own; without training texts all counts are zero and scores are those of the
smoothed root (0 for every token if there are no tokens at all); an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_rows
from . import common as C

ORDER, MU, FOLDS, ADD = 2, 2.0, 10, 0.1
SLICE_TOKENS, SHARD_BYTES = 1 << 20, 16 << 20
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_STEP = np.uint64(0xD1342543DE82EF95)
PARTS = "batch long, level int, shard int, parts array<binary>"


def _pack(x: np.ndarray) -> bytes:
    """An integer array, compressed by significance of its bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpack(raw, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(raw)), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def token_runs(batches, limit: int = SLICE_TOKENS):
    """(doc ids, held out, token keys, row offsets, first row number) of slices of
    about ``limit`` tokens, with the start and the end of each text."""
    roll = C.Rolling(8)
    rows_of, seqs, ats, n = [], [], [np.zeros(1, np.int64)], 0

    def run():
        table = pa.Table.from_batches(rows_of).select(["_row", "doc_id", "held_out"]).combine_chunks()
        return table, np.concatenate(seqs), np.concatenate(ats)
    for rows, data, offs in C.text_slices(batches):
        low = C.lower_ascii(data)
        starts, ends, at = C.words(low, offs)
        at2 = at + 2 * np.arange(len(offs))
        seq = np.empty(at2[-1], dtype=np.uint64)
        seq[at2[:-1]] = START
        seq[at2[1:] - 1] = END
        seq[np.arange(len(starts)) + 2 * C.row_of(at) + 1] = roll.words(low, starts, ends)
        rows_of.append(rows.select(["_row", "doc_id", "held_out"]))
        seqs.append(seq)
        ats.append(at2[1:] + n)
        n += len(seq)
        if n >= limit:
            yield run()
            rows_of, seqs, ats, n = [], [], [np.zeros(1, np.int64)], 0
    if rows_of:
        yield run()


class Slice:
    """N-grams of a slice: for each level n, the positions at which an n-gram ends,
    the slice's distinct n-grams in order, and their numbers there."""

    def __init__(self, seq: np.ndarray, at: np.ndarray, order: int):
        self.row = C.row_of(at)
        inner = np.arange(len(seq)) - at[self.row]
        key = seq
        self.levels = []
        for n in range(1, order + 1):
            if n > 1:
                key = C.mix(np.r_[np.uint64(0), key[:-1]] * _STEP + seq + np.uint64(n))
            ends_at = np.flatnonzero(inner >= n - 1)
            distinct, number = np.unique(key[ends_at], return_inverse=True)
            self.levels.append((ends_at, distinct, number))


def _shard_edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of the sorted keys starts."""
    return np.searchsorted(((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32), np.arange(shards + 1))


class Stored:
    """A stored slice: documents, their folds and their token sequences."""

    def __init__(self, parts):
        raw = [p.as_buffer() for p in parts]
        self.ids, self.none, self.held = (_unpack(raw[i], t) for i, t in enumerate((np.int64, np.uint8, np.uint8)))
        self.at = _unpack(raw[3], np.int64)
        self.seq = np.cumsum(_unpack(raw[4], np.uint64), dtype=np.uint64)[_unpack(raw[5], np.uint32)]


def _requests(slices: DataFrame, order: int, shards: int) -> DataFrame:
    """One row for each slice, level and shard: keys and training counts."""
    def run(batches):
        for batch in batches:
            for own, parts in zip(batch.column("batch").to_pylist(), batch.column("parts")):
                it = Stored(parts)
                s = Slice(it.seq, it.at, order)
                train = it.held == 0
                out = []
                for n, (ends_at, keys, number) in enumerate(s.levels, 1):
                    count = np.bincount(number, weights=train[s.row[ends_at]], minlength=len(keys)).astype(np.uint32)
                    edge = _shard_edges(keys, shards)
                    for k in np.flatnonzero(np.diff(edge)).tolist():
                        part = keys[edge[k]:edge[k + 1]]
                        out.append((n, k, [_pack(np.diff(part, prepend=np.uint64(0))), _pack(count[edge[k]:edge[k + 1]])]))
                level, shard, parts = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(out), pa.int64()), pa.array(level, pa.int32()),
                                                  pa.array(shard, pa.int32()), pa.array(parts, pa.list_(pa.binary()))], ["batch", "level", "shard", "parts"])
    return slices.mapInArrow(run, PARTS)


def _answers(requests: DataFrame) -> DataFrame:
    """The same rows with the totals of their keys; one row a shard also carries its
    sum of training tokens and its number of known tokens."""
    def run(table: pa.Table) -> pa.Table:
        level, shard = table.column("level")[0].as_py(), table.column("shard")[0].as_py()
        parts = table.column("parts").combine_chunks()
        keys = [np.cumsum(_unpack(p[0].as_buffer(), np.uint64), dtype=np.uint64) for p in parts]
        counts = np.concatenate([_unpack(p[1].as_buffer(), np.uint32) for p in parts])
        size = np.array([len(k) for k in keys])
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, weights=counts, minlength=len(distinct)).astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        out = [[_pack(total[number[a:b]])] for a, b in zip(edge, edge[1:])]
        tokens = total[distinct != START] if level == 1 else total[:0]
        first = [0] * (len(out) - 1)
        return pa.table({"batch": table.column("batch"), "level": pa.array([level] * len(out), pa.int32()), "shard": pa.array([shard] * len(out), pa.int32()),
                         "parts": pa.array(out, pa.list_(pa.binary())), "tokens": pa.array([int(tokens.sum()), *first], pa.int64()),
                         "known": pa.array([int((tokens > 0).sum()), *first], pa.int64())})
    return requests.groupBy("level", "shard").applyInArrow(run, PARTS + ", tokens long, known long")


def _sequences(docs: DataFrame) -> DataFrame:
    """One row for each slice: its documents and their token sequences, as the
    distinct tokens and their numbers."""
    def run(batches):
        for rows, seq, at in token_runs(batches):
            ids = rows.column("doc_id").combine_chunks()
            distinct, number = np.unique(seq, return_inverse=True)
            parts = [_pack(ids.fill_null(0).to_numpy()), _pack(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)),
                     _pack(rows.column("held_out").to_numpy().astype(np.uint8)), _pack(at),
                     _pack(np.diff(distinct, prepend=np.uint64(0))), _pack(number.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([rows.column("_row")[0].as_py()], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int32()),
                                              pa.array([parts], pa.list_(pa.binary()))], ["batch", "level", "shard", "parts"])
    return docs.mapInArrow(run, PARTS)


def automaton_weights(at: np.ndarray, numbers: list[np.ndarray], counts: list[np.ndarray], n_train: int, n_known: int, mu: float):
    """(log10 of the root's arc, log10 of the path taken) for every position after a
    start. ``counts[n - 1][numbers[n - 1]]`` are the totals of the n-grams that end
    at positions of n - 1 tokens or more after the start."""
    row = C.row_of(at)
    inner = np.arange(at[-1]) - at[row]
    seen = []
    for n, (number, count) in enumerate(zip(numbers, counts), 1):
        full = np.zeros(at[-1], dtype=np.int64)
        full[inner >= n - 1] = count[number]
        seen.append(full)
    with np.errstate(divide="ignore", invalid="ignore"):
        root = np.log10((seen[0] + ADD) / (n_train + ADD * (n_known + 1)))
        path = root
        for n in range(2, len(seen) + 1):
            state = np.r_[np.int64(0), seen[n - 2][:-1]]  # count of the n - 1 tokens before
            fail = np.log10(mu / (state + mu)) + path
            arc = np.log10((seen[n - 1] + mu * 10.0 ** path) / (state + mu))
            path = np.where(inner >= n - 1, np.where(seen[n - 1] > 0, arc, fail), path)
    return root, path, seen[0]


def _scored(groups: DataFrame, order: int, n_train: int, n_known: int, mu: float) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        found = sorted(zip(table.column("level").to_pylist(), table.column("shard").to_pylist(), range(table.num_rows)))
        parts = table.column("parts").combine_chunks()
        own = Stored(parts[found[0][2]])
        ids, none, held, at = own.ids, own.none, own.held, own.at
        levels = Slice(own.seq, at, order).levels
        counts = [np.concatenate([np.zeros(0, np.int64)] + [_unpack(parts[i][0].as_buffer(), np.int64) for lv, _, i in found if lv == n]) for n in range(1, order + 1)]
        numbers = [number for _, _, number in levels]
        root, path, seen = automaton_weights(at, numbers, counts, n_train, n_known, mu)
        # the start of a text is no token: sum from the position after it
        cut = np.column_stack([at[:-1] + 1, at[1:]]).ravel()[:-1]
        add = lambda x: np.add.reduceat(x, cut)[::2]
        return pa.table({"doc_id": pa.array(ids, mask=none.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(np.diff(at) - 1),
                         "n_known": pa.array(add((seen > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(ids), n_train, np.int64)),
                         "base_score": pa.array(add(root)), "score": pa.array(add(path))})
    return groups.groupBy("batch").applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, order: int = ORDER, mu: float = MU, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = C.numbered(C.id_text(docs)).withColumn("held_out", C.crc_mod("doc_id", folds) == 0)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-size // SHARD_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slices = C.store(_sequences(docs), "slices")
    with arrow_rows(docs.sparkSession, 1):  # a row is a whole slice
        answers = C.store(_answers(_requests(slices, order, shards)), "answers")
    n_train, n_known = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("known")).first())
    both = slices.unionByName(answers.drop("tokens", "known"))
    return _scored(both, order, n_train, n_known, mu)


ORACLE = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, list_append(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), ' ') AS w FROM d),
t AS MATERIALIZED (SELECT doc_id, unnest(w) AS w, unnest(list_prepend('', w[:-2])) AS h FROM w),
k AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS k),
h AS MATERIALIZED (SELECT doc_id, xor(list_reduce(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT),
                                                  lambda c, x: xor(c // 256, k[xor(c % 256, x) + 1]), 4294967295), 4294967295) % {FOLDS} = 0 AS held_out FROM d, k),
tr AS MATERIALIZED (SELECT t.* FROM t JOIN h USING (doc_id) WHERE NOT held_out),
c AS MATERIALIZED (SELECT w, count(*) AS c FROM tr GROUP BY 1),
s AS MATERIALIZED (SELECT h, count(*) AS s FROM tr GROUP BY 1),
b AS MATERIALIZED (SELECT h, w, count(*) AS b FROM tr GROUP BY ALL),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c),
p AS (SELECT doc_id, coalesce(c, 0) AS c, n, (coalesce(c, 0) + {ADD}) / (n + {ADD} * (v + 1)) AS p, coalesce(s, 0) AS s, coalesce(b, 0) AS b
      FROM t LEFT JOIN c USING (w) LEFT JOIN s USING (h) LEFT JOIN b USING (h, w), n)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens,
       round(fsum(log10(p)), 6) AS base_score, round(fsum(log10((b + {MU} * p) / (s + {MU}))), 6) AS score
FROM p JOIN h USING (doc_id) GROUP BY doc_id
"""


def op8_backoff_lm(spark, sf_dir):
    return score(C.table(spark, sf_dir, "documents")).withColumn("base_score", F.round("base_score", 6)).withColumn("score", F.round("score", 6))
