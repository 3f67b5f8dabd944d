"""Quality rules on repetition, from a suffix array of every text's words.

The suffixes of a text (over words) are sorted by prefix doubling; the longest
common prefix of neighbours in that order bounds the LCP intervals, and the
deepest interval of a suffix gives the longest repeated substring that starts
there. Each such span is a maximal repeat or lies inside the span of one that
starts further left, so the union of all spans of ``min_repeat`` words or more is
what the maximal repeats cover. A text is kept if it passes the base rules, that
union is at most ``max_covered`` of its words, and no repeat is longer than
``max_longest`` words.

One pass, no shuffle: a text is a row, in memory at once with about 100 bytes a
word. Null text has no words and fails the base rules; a null doc_id stays null;
repeated rows give repeated rows; an empty table gives none; further columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.3, 200
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_ranks(ids: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes, row by row, by their first 1, 2, 4, … words; the last
    entry has no ties. Only suffixes still tied are sorted again."""
    n = len(ids)
    row, end = C.row_of(offs), np.repeat(offs[1:], np.diff(offs))
    key = (row.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]][:n]
    start = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start[np.cumsum(new) - 1]
    levels = [rank]
    sizes = np.diff(np.r_[start, n])
    tied = order[np.repeat(sizes > 1, sizes)]
    step = 1
    while len(tied):
        after = tied + step
        inside = after < end[tied]
        second = np.zeros(len(tied), dtype=np.int64)
        second[inside] = rank[after[inside]] + 1
        by = np.lexsort((second, rank[tied]))
        t, first, second = tied[by], rank[tied[by]], second[by]
        group = np.r_[True, first[1:] != first[:-1]]
        part = group | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(t))
        group_start = np.maximum.accumulate(np.where(group, at, 0))
        part_start = np.maximum.accumulate(np.where(part, at, 0))
        rank = rank.copy()
        rank[t] = first + part_start - group_start
        levels.append(rank)
        starts = np.flatnonzero(part)
        sizes = np.diff(np.r_[starts, len(t)])
        tied = t[np.repeat(sizes > 1, sizes)]
        step *= 2
    return levels


def repeat_lengths(ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For every word, the length of the longest substring that starts there and
    occurs again in the same row."""
    n = len(ids)
    best = np.zeros(n, dtype=np.int64)
    if n < 2:
        return best
    end = np.repeat(offs[1:], np.diff(offs))
    levels = suffix_ranks(ids, offs)
    order = np.empty(n, dtype=np.int64)
    order[levels[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    same = levels[0][a] == levels[0][b]
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), dtype=np.int64)
    for power in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = (x < end[a]) & (y < end[b])
        ok[ok] = levels[power][x[ok]] == levels[power][y[ok]]
        lcp[ok] += 1 << power
    best[b] = lcp  # each suffix has one neighbour on either side
    best[a] = np.maximum(best[a], lcp)
    return best


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[offs[1:]] - total[offs[:-1]]).astype(np.int64)


def _dup_lines(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, rolling: C.Rolling) -> np.ndarray:
    """Per row, the lines with a word that equal an earlier line of the row."""
    breaks = np.flatnonzero(data == 10)
    a = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    row = np.searchsorted(offs, a, side="right") - 1
    # a break that ends a row's text opens one more, empty line, which has no word; so have empty rows
    b = np.minimum(np.concatenate([a[1:], [len(data)]]), offs[np.minimum(row + 1, len(offs) - 1)])
    b = np.where((b > a) & (data[np.maximum(b - 1, 0)] == 10), b - 1, b) if len(data) else b
    worded = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b, row = a[worded], b[worded], row[worded]
    h = rolling.words(data, a, b)
    by = np.lexsort((h, row))
    same = (h[by][1:] == h[by][:-1]) & (row[by][1:] == row[by][:-1])
    return np.bincount(row[by][1:][same], minlength=len(offs) - 1).astype(np.int64)


def measure(data: np.ndarray, offs: np.ndarray, rolling: C.Rolling, min_repeat: int) -> dict[str, np.ndarray]:
    """Counts of every row of a slice."""
    starts, ends, at = C.words(data, offs)
    n = len(starts)
    _, ids = np.unique(rolling.words(data, starts, ends), return_inverse=True)
    length = repeat_lengths(ids, at)
    three = np.flatnonzero(length >= 3)
    long = np.flatnonzero(length >= min_repeat)
    longest = np.zeros(len(offs) - 1, dtype=np.int64)
    np.maximum.at(longest, C.row_of(at), length)
    char = ((data & 0xC0) != 0x80) & ~C._SPACE[data]
    return {"n_words": np.diff(at).astype(np.int64), "word_chars": _sums(char, offs), "n_symbols": _sums(_SYMBOL[data], offs),
            "n_dup_lines": _dup_lines(data, offs, starts, rolling),
            "n_repeat_words": _sums(_covered(three, np.full(len(three), 3), n), at),
            "n_covered": _sums(_covered(long, length[long], n), at), "longest_repeat": longest}


def repetition_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
                     max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per document with its counts, base_failed and the verdict kept."""
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]

    def run(batches):
        rolling = C.Rolling(9)
        for rows, data, offs in C.text_slices(batches):
            m = measure(data, offs, rolling, min_repeat)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
            kept = ~failed & (m["n_covered"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(m[k]) for k in longs), pa.array(failed), pa.array(kept)],
                                             ["doc_id", *longs, "base_failed", "kept"])
    return C.id_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in longs) + ", base_failed boolean, kept boolean")


def op9_repetition(spark, sf_dir):
    return repetition_rules(C.table(spark, sf_dir, "documents"))
