"""Removal of repeated passages, found through difference-cover anchors.

A passage is a window of 50 words. A word goes if it is covered by a window that
also starts in a document with a smaller id.

1. Anchors: hashes of 20-word windows, taken only where the word position modulo
   31 is in a difference cover (6 of 31 positions). For any two alignments some
   offset below 31 falls on cover positions in both texts, so two equal windows
   of 20 + 31 - 1 = 50 words always share an anchor inside them.
2. Anchors found in two documents or more mark the only places where an equal
   window can be; everything else leaves the job here. A document can lose words
   only around anchors that a smaller id has too, and can make a larger id lose
   words only around anchors that a larger id has.
3. Extension: the 50-word windows around the latter anchors get a 128-bit hash
   and the smallest id of each is aggregated; the windows around the former meet
   it in a join.
4. Only texts with a marked anchor move to their windows.

Passages that many documents share are reduced by partial aggregation; the joins
are plain equi-joins of shuffled sides, which Spark splits where a key is hot.
Bit filters of bounded size keep rows without a partner out of the shuffles.

Rows: null text has no words; a null doc_id counts as larger than every id; rows
that repeat a doc_id are one document, so none of them loses words to another;
an empty table gives an empty result; further columns are not read. A text is
one row, in memory at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .bits import bit_filter

WINDOW, PERIOD = 50, 31
COVER = (1, 5, 11, 24, 25, 27)
LAST = (1 << 63) - 1


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Slice:
    """Words of a slice of texts, with their hashes and each row's word range."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, roll: C.Rolling):
        self.data, self.roll = data, roll
        self.starts, self.ends, self.at = C.words(data, offs)
        self.hash = roll.words(data, self.starts, self.ends)
        self.row = C.row_of(self.at)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the slice where anchors start, and their hashes."""
        size = window - PERIOD + 1
        taken = np.zeros(PERIOD, dtype=bool)
        taken[list(COVER)] = True
        i = np.arange(len(self.starts))
        ok = taken[(i - self.at[self.row]) % PERIOD] & (i + size <= self.at[self.row + 1])
        ok &= np.diff(self.at)[self.row] >= window
        i = i[ok]
        return i, self.roll.ranges(self.hash, i, i + size).astype(np.int64)


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(h, d) for every anchor; d is the id, a null id the largest."""
    def run(batches):
        roll = C.Rolling(4)
        for rows, data, offs in C.text_slices(batches):
            s = _Slice(data, offs, roll)
            i, h = s.anchors(window)
            d = rows.column("d").to_numpy()[s.row[i]]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d)], ["h", "d"])
    return docs.select("d", "text").mapInArrow(run, "h long, d long")


def _marked(docs: DataFrame, window: int, shared) -> DataFrame:
    """Per document its word count, the hash of all its words and the anchors that
    the filter of shared anchors lets through."""
    def run(batches):
        roll = C.Rolling(4)
        for rows, data, offs in C.text_slices(batches):
            s = _Slice(data, offs, roll)
            i, h = s.anchors(window)
            ok = shared.has(h)
            i, h = i[ok], h[ok]
            per_row = np.searchsorted(s.row[i], np.arange(len(offs))).astype(np.int32)
            place = (i - s.at[s.row[i]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("_row"), rows.column("doc_id"), pa.array(np.diff(s.at).astype(np.int64)),
                 _hashes(s, offs, slice(None)),
                 pa.ListArray.from_arrays(per_row, pa.array(h)), pa.ListArray.from_arrays(per_row, pa.array(place))],
                ["_row", "doc_id", "n_words", "sha", "h", "p"])
    return docs.select("_row", "doc_id", "text").mapInArrow(
        run, "_row long, doc_id long, n_words long, sha string, h array<long>, p array<int>")


def _hashes(s: _Slice, offs: np.ndarray, kept: np.ndarray | slice) -> pa.Array:
    """SHA-256 of each row's words that stay, joined by one space."""
    raw, at = C.joined(s.data, offs, s.starts[kept], s.ends[kept])
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string())


def _windows(texts: DataFrame, window: int, places: str) -> DataFrame:
    """(w1, w2, d, _row, i) of every window that holds an anchor at one of the places."""
    def run(batches):
        one, two = C.Rolling(4), C.Rolling(5)
        size = window - PERIOD + 1
        for rows, data, offs in C.text_slices(batches):
            s = _Slice(data, offs, one)
            lists = rows.column(places)
            row = C.row_of(lists.offsets.to_numpy())
            p = lists.flatten().to_numpy() + s.at[row]
            edge = np.zeros(len(s.starts) + 1, dtype=np.int64)
            np.add.at(edge, np.maximum(p - (window - size), s.at[row]), 1)
            np.add.at(edge, p + 1, -1)
            i = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            i = i[i + window <= s.at[s.row[i] + 1]]
            second = two.words(data, s.starts, s.ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.ranges(s.hash, i, i + window).astype(np.int64)), pa.array(two.ranges(second, i, i + window).astype(np.int64)),
                 pa.array(rows.column("d").to_numpy()[s.row[i]]), pa.array(rows.column("_row").to_numpy()[s.row[i]]),
                 pa.array((i - s.at[s.row[i]]).astype(np.int32))], ["w1", "w2", "d", "_row", "i"])
    return texts.where(F.size(places) > 0).select("_row", "d", "text", places).mapInArrow(run, "w1 long, w2 long, d long, _row long, i int")


def _removed(texts: DataFrame, window: int) -> DataFrame:
    """(_row, n_removed, kept_sha) of texts with the places of windows to remove."""
    def run(batches):
        roll = C.Rolling(4)
        for rows, data, offs in C.text_slices(batches):
            s = _Slice(data, offs, roll)
            lists = rows.column("i")
            place = lists.flatten().to_numpy() + s.at[C.row_of(lists.offsets.to_numpy())]
            edge = np.zeros(len(s.starts) + 1, dtype=np.int64)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays(
                [rows.column("_row"), pa.array(total[s.at[1:]] - total[s.at[:-1]]),
                 _hashes(s, offs, ~gone)],
                ["_row", "n_removed", "kept_sha"])
    return texts.select("_row", "text", "i").mapInArrow(run, "_row long, n_removed long, kept_sha string")


def _mixed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(C.mix(b.column(0).to_numpy()).astype(np.int64))], ["rh"])


def _filtered(docs: DataFrame, rows) -> DataFrame:
    """Rows whose number may be in the filter."""
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(rows.has(C.mix(b.column("_row").to_numpy()).astype(np.int64))))
    return docs.mapInArrow(run, docs.schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: _row, doc_id, n_words, n_removed, kept_sha256."""
    if window < PERIOD or not is_cover(COVER, PERIOD):
        raise ValueError("a window must be as long as the cover's period at least")
    docs = C.identified_text(docs).withColumn("d", F.coalesce("doc_id", F.lit(LAST)))
    shared = C.store(_anchors(docs, window).groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi"), "anchors")
    base = C.store(_marked(docs, window, bit_filter(shared, "h", shared.count())), "marked")
    marked = (base.where(F.size("h") > 0).select("_row", F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.explode(F.arrays_zip("h", "p")).alias("a"))
              .select("_row", "d", "a.h", "a.p").join(shared, "h"))
    places = C.store(marked.groupBy("_row").agg(F.collect_list(F.when(F.col("hi") > F.col("d"), F.col("p"))).alias("gives"),
                                                F.collect_list(F.when(F.col("lo") < F.col("d"), F.col("p"))).alias("takes")), "places")
    mixed = places.select("_row").mapInArrow(_mixed, "rh long")
    texts = C.store(_filtered(docs.select("_row", "d", "text"), bit_filter(mixed, "rh", places.count())).join(places, "_row"), "texts")
    first = C.store(_windows(texts, window, "gives").groupBy("w1", "w2").agg(F.min("d").alias("lo")), "windows")
    hits = _windows(texts, window, "takes").join(first, ["w1", "w2"]).where("d > lo").groupBy("_row").agg(F.collect_list("i").alias("i"))
    hits = C.store(hits, "hits")
    cut = _removed(texts.select("_row", "text").join(hits, "_row"), window)
    return (base.select("_row", "doc_id", "n_words", "sha").join(cut, "_row", "left")
            .select("_row", "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                    F.coalesce("kept_sha", "sha").alias("kept_sha256")))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup(C.table(spark, sf_dir, "documents")).drop("_row")
