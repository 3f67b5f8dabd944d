"""Helpers the operators of this subpackage share: safe column selection, tables
in the shared folder, and vectorised tokenisation of Arrow text inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

SLICE_BYTES = 1 << 20  # text bytes that one numpy pass works on; a longer text is a slice of its own

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


store = stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, *more) -> DataFrame:
    """doc_id and text alone, so that further columns can't clash; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """A row number that tells repeated rows apart, for one job alone: another job may
    pack the files into other splits and number the rows anew (``numbered_once``)."""
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered_once(df: DataFrame, name: str = "_row") -> DataFrame:
    """df with its row numbers, written once, so that every later job reads the same
    numbers, however many cores there are by then."""
    return store(numbered(df, name), "numbered")


def identified(docs: DataFrame, name: str = "_row", columns: list | None = None) -> DataFrame:
    """``columns`` of docs (all) and a number that is a row's own in every job, however the
    files are packed into splits: its file's number and its place in the file. Nothing
    is copied. Rows that are not a plain scan of files are numbered and stored once."""
    columns = [docs[c] for c in docs.columns] if columns is None else columns
    try:
        at = docs.select(*columns, F.col("_metadata.file_path").alias("_file_path"), F.col("_metadata.row_index").alias("_row_index"))
    except AnalysisException:
        return numbered_once(docs.select(*columns), name)
    paths = docs.select(F.col("_metadata.file_path").alias("_file_path")).distinct()
    # as many rows as files, whose list the driver holds for the scan as it is
    files = store(paths.select("_file_path", F.row_number().over(Window.orderBy("_file_path")).cast("long").alias("_file")), "files")
    at = at.join(F.broadcast(files), "_file_path").withColumn(name, F.shiftleft("_file", 40).bitwiseOR(F.col("_row_index")))
    return at.drop("_file_path", "_row_index", "_file")


def identified_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row), with ``_row`` as by ``identified``; null text is empty."""
    return identified(docs, "_row", [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")])


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def raw_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column (nulls are empty)."""
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    n, at = len(col), col.offset
    offs = np.frombuffer(col.buffers()[1], dtype=kind, count=at + n + 1)[at:].astype(np.int64) if n else np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in slices of about ``size`` bytes, whole texts only."""
    for batch in batches:
        data, offs = raw_text(batch.column(column))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
            yield batch.slice(lo, hi - lo), data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
            lo = hi


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+``, and each row's
    range in those arrays."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    filled = offs[1:] > offs[:-1]
    keep = inside[:-1].copy()
    cut = offs[:-1][filled]
    cut = cut[cut > 0] - 1  # no word runs on into the next row
    keep[cut[cut < len(keep)]] = False
    first[1:] &= ~keep
    after = inside[1:].copy()
    after[cut[cut < len(after)]] = False
    last[:-1] &= ~after
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit polynomial hashes of many ranges at once, by differences of one
    running sum: hash(a, b) = (sum[b] - sum[a]) * P^-a, then mixed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.bytes = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 60, 1 << 62)) * 2 + 1
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                p = np.full(n, base & ((1 << 64) - 1), dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def ranges(self, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of values[a:b] for arrays a, b; values are uint64."""
        self._grow(len(values) + 1)
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:len(values)], out=total[1:])
        return mix((total[b] - total[a]) * self.down[a] + (b - a).astype(np.uint64))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.ranges(self.bytes[data], starts, ends)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def code_points(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Code points of each row: bytes that don't continue a sequence."""
    total = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return (total[offs[1:]] - total[offs[:-1]]).astype(np.int64)


def joined(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int]]:
    """The given words of every row joined by one space, as bytes and row offsets."""
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    row = np.searchsorted(offs, starts, side="right") - 1
    gaps = ends[:-1][row[1:] == row[:-1]]  # another word of the row follows, so this byte is its own
    out = data.copy()
    out[gaps] = 32
    keep[gaps] = True
    return out[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[offs].tolist()


def row_of(offs: np.ndarray) -> np.ndarray:
    """Row number of every element, from row offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))
