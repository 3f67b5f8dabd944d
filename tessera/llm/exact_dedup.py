"""Exact deduplication by content-defined chunk recipes.

A text without its white space is cut where a rolling hash of the last 16 bytes
meets a condition, so equal texts get equal chunks wherever the text comes from.
Chunk contents move once: they are deduplicated by fingerprint, and a
fingerprint is a verified identifier if all contents under it are the same
bytes. Documents are then compared by their ordered identifier lists (their
recipes, about 1 % of the text), and the texts stay where they are. A chunk
whose fingerprint turned out to stand for several contents is written into the
recipe as its own bytes, so equal recipes always mean equal texts.

Rows: null text is the empty text; a null doc_id loses every tie; of rows that
repeat a doc_id and a text one is kept, by row number. All-blank texts are equal
to the empty text. An empty table gives an empty result. Further columns are
not read. A text is one row, in memory at once; a group of copies is reduced by
partial aggregation, and its rows meet their group in a join that Spark may split.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 10, 8192
MAX_COLLIDED = 100_000


def _cuts(data: np.ndarray, offs: np.ndarray) -> list[list[int]]:
    """Chunk boundaries of each row. A boundary depends on the 16 bytes before
    it and on the boundary before it, so on nothing outside the row."""
    gear = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint32)
    h = gear[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    marks = (np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + 1).tolist()
    out = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        cuts = [a]
        while b - cuts[-1] > MIN_CHUNK:
            i = bisect_left(marks, cuts[-1] + MIN_CHUNK)
            at = min(marks[i] if i < len(marks) else b, cuts[-1] + MAX_CHUNK, b)
            cuts.append(at)
        if cuts[-1] < b:
            cuts.append(b)
        out.append(cuts)
    return out


def _squeezed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = ~C._SPACE[data]
    total = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], total[offs]


def _fingerprint(chunk: bytes, width: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:width]


def chunks(docs: DataFrame, width: int = 16) -> DataFrame:
    """(fp, content) of every chunk of every text."""
    def run(batches):
        for _, data, offs in C.text_slices(batches):
            data, offs = _squeezed(data, offs)
            raw = data.tobytes()
            parts = [raw[a:b] for cuts in _cuts(data, offs) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_fingerprint(p, width) for p in parts], pa.binary()), pa.array(parts, pa.binary())], ["fp", "content"])
    return docs.select("text").mapInArrow(run, "fp binary, content binary")


def collided(docs: DataFrame, width: int = 16) -> set[bytes]:
    """Fingerprints that stand for more than one content. None is expected at any
    corpus size with 16 bytes; over MAX_COLLIDED of them the job ends with an error."""
    rows = (chunks(docs, width).groupBy("fp").agg(F.min("content").alias("a"), F.max("content").alias("b"))
            .where(F.col("a") != F.col("b")).select("fp").limit(MAX_COLLIDED + 1).collect())
    if len(rows) > MAX_COLLIDED:
        raise ValueError("too many chunk contents share a fingerprint; use wider fingerprints")
    return {bytes(r.fp) for r in rows}


def recipes(docs: DataFrame, bad: set[bytes], width: int = 16) -> DataFrame:
    """(_row, doc_id, n_chars, text_sha256, recipe) of every document."""
    def run(batches):
        for rows, data, offs in C.text_slices(batches):
            n_chars = C.code_points(data, offs)
            data, offs = _squeezed(data, offs)
            raw = data.tobytes()
            recipe, sha = [], []
            for cuts in _cuts(data, offs):
                sha.append(hashlib.sha256(raw[cuts[0]:cuts[-1]]).hexdigest())
                ids = []
                for a, b in zip(cuts, cuts[1:]):
                    fp = _fingerprint(raw[a:b], width)
                    ids.append(b"\1" + (b - a).to_bytes(8, "big") + raw[a:b] if fp in bad else b"\0" + fp)
                recipe.append(b"".join(ids))
            yield pa.RecordBatch.from_arrays(
                [rows.column("_row"), rows.column("doc_id"), pa.array(n_chars), pa.array(sha, pa.string()), pa.array(recipe, pa.binary())],
                ["_row", "doc_id", "n_chars", "text_sha256", "recipe"])
    return docs.select("_row", "doc_id", "text").mapInArrow(
        run, "_row long, doc_id long, n_chars long, text_sha256 string, recipe binary")


def exact_dedup(docs: DataFrame, fingerprint_bytes: int = 16) -> DataFrame:
    """One row per document: _row, doc_id, keep_id, group_size, kept, text_sha256,
    n_chunks. The row with the most code points, then the smallest doc_id, stays."""
    # the numbers are made in one job, which stores them with the recipes
    return exact_rows(C.numbered(C.id_text(docs)), fingerprint_bytes)


def exact_rows(docs: DataFrame, fingerprint_bytes: int = 16) -> DataFrame:
    """exact_dedup of rows (_row, doc_id, text)."""
    done = C.store(recipes(docs, collided(docs, fingerprint_bytes), fingerprint_bytes), "recipes")
    best = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    groups = C.store(done.groupBy("recipe").agg(F.min(best).alias("best"), F.count("*").alias("size")).where("size > 1")
                     .select("recipe", F.col("best.id").alias("best_id"), F.col("best.row").alias("best_row"), "size"), "copies")
    single = F.col("size").isNull()
    return done.join(groups, "recipe", "left").select(
        "_row", "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("_row") == F.col("best_row"))).alias("kept"),
        "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(C.table(spark, sf_dir, "documents")).drop("_row")
