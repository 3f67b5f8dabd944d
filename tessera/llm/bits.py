"""Bit filters of bounded size, used ahead of exact joins: a row that a filter
lets through by mistake is dropped by the join after it, so a filter only saves
movement and never decides a result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 16, 1 << 26  # 8 MB at most, whatever the number of keys
SHIFTS = (0, 20, 38)


class Filter:
    def __init__(self, log2: int, filled: np.ndarray):
        self.log2, self.filled = log2, filled

    def __contains__(self, keys: np.ndarray) -> bool:  # pragma: no cover - arrays only
        raise TypeError("use has()")

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys).astype(np.uint64)
        ok = np.ones(len(keys), dtype=bool)
        for shift in SHIFTS:
            at = (keys >> np.uint64(shift)) & np.uint64((1 << self.log2) - 1)
            ok &= (self.filled[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok


def bit_filter(keys: DataFrame, column: str, n_keys: int) -> Filter:
    """Filter of a column of well-mixed longs. The bits are set by an aggregation;
    at most MAX_BITS / 64 words come to the driver."""
    log2 = int(np.clip(12 * max(n_keys, 1), MIN_BITS, MAX_BITS)).bit_length() - 1
    at = [F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit((1 << log2) - 1)) for s in SHIFTS]
    rows = (keys.select(F.explode(F.array(*at)).alias("at"))
            .groupBy(F.shiftright("at", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS INT))")).alias("bits")).toPandas())
    filled = np.zeros((1 << log2) // 64, dtype=np.uint64)
    filled[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint64)
    return Filter(log2, filled)
