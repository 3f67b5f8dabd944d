"""Toxicity: a support vector machine with a subsequence string kernel and Nyström landmarks.

* Strings. A text's words, in lower case and without characters that aren't letters,
  each after a mark for its start; runs of three or more words of one letter are one
  string (``i d i o t``), and longer ones than ``LONGEST`` bytes are overlapping windows.
* Kernel. Two strings are compared by their common subsequences of four bytes with up
  to three bytes left out; each occurrence counts ``DECAY`` to the power of its gaps, and
  the kernel is normalised by the strings' own. So an insult with characters inserted,
  split by blanks or followed by an ending still shares most subsequences with it. A
  subsequence is a 32-bit number, so the kernel is an exact sparse product and costs
  twenty table lookups a byte.
* Landmarks. From the labelled sentences (every sentence carries the label of its
  document): the beginnings of words that toxic texts hold more often than the rest, by
  log-likelihood ratio, and of the rest the commonest words and those most like the
  former. A string's features are its
  kernels with the landmarks times the inverse root of the landmarks' kernel matrix.
* Machine. A squared hinge loss over strings, weighted by how often toxic and other
  sentences hold them (at most ``PER_TEXT`` times a text, toxic ones with the factor
  ``TOXIC_WEIGHT``), by Newton steps. As it is
  linear in the features, it is folded into one weight for each subsequence of a
  landmark, and scoring needs no landmark.
* Text. A sentence is toxic by its words of positive margin. A logistic curve over the
  numbers and shares of such words and sentences and the largest margin, fitted on
  the same texts, gives the score.

Training takes a sample of labelled rows, bounded by ``max_rows``: those with the
smallest hash of their id; of their words that are far from all landmarks, a sample
with weights in place of the rest. Scoring reads all whole texts in one pass without a
shuffle. Labels, language, source and id are no features.

Rows: null text is the empty text and gets a score like any other; a null id is held
in or out by the crc of the empty text and never matches a label; labels that repeat
an id count once, by their maximum, and null labels not at all; texts that repeat an
id all train. Without labelled rows, or with one class only, every score is the
smoothed share of toxic rows, (toxic + 1) / (all + 2). An empty table gives an empty
result; further columns are not read. A text is one row, in memory at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .factorization import sigmoid

MAX_ROWS, FOLDS, HELD, CUT = 4_000, 3, 1, 0.7
ORDER, GAPS, DECAY = 4, 3, 0.8
LONGEST, STRIDE, LETTERS_APART = 32, 16, 3
TOXIC_LANDMARKS, OTHER_LANDMARKS, ALIKE, LEAST_RATIO, LANDMARK_BYTES = 48, 16, 8, 25.0, (4, 14)
PER_TEXT, TOXIC_WEIGHT, NEAR, FAR_WORDS = 3, 2.0, 0.2, 40_000
CACHED = 200_000

START = 94  # ^, which is no letter
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
#: Places of a subsequence's bytes after its first.
STEPS = [s for s in combinations(range(1, ORDER + GAPS), ORDER - 1)]


def strings(data: np.ndarray, offs: np.ndarray, roll: C.Rolling):
    """Rows and sentences of all strings, the number of each one's distinct string, and
    these as (bytes, offsets, hashes). data is in lower case."""
    starts, ends, at = C.words(data, offs)
    letter = _LETTER[data]
    total = np.concatenate([[0], np.cumsum(letter)])
    kept, a, b = data[letter], total[starts], total[ends]
    row = C.row_of(at)
    line = np.concatenate([[0], np.cumsum(data == 10)])
    stops = np.zeros(len(starts), dtype=bool)
    if len(starts):
        stops[1:] = _STOP[data[ends[:-1] - 1]] | (line[starts[1:]] > line[ends[:-1]]) | (row[1:] != row[:-1])
    sentence = np.cumsum(stops)
    filled = b > a
    a, b, row, sentence = a[filled], b[filled], row[filled], sentence[filled]
    # runs of single letters
    points = np.concatenate([[0], np.cumsum((kept & 0xC0) != 0x80)])
    single = points[b] - points[a] == 1
    begin = np.ones(len(a), dtype=bool)
    begin[1:] = ~(single[1:] & single[:-1] & (sentence[1:] == sentence[:-1]))
    first = np.flatnonzero(begin)
    size = np.diff(np.r_[first, len(a)])
    merged = size >= LETTERS_APART
    own = np.repeat(~merged, size)
    a, b = np.r_[a[own], a[first[merged]]], np.r_[b[own], b[first[merged] + size[merged] - 1]]
    row, sentence = np.r_[row[own], row[first[merged]]], np.r_[sentence[own], sentence[first[merged]]]
    # windows of long strings
    n = np.maximum(1, -(-(b - a - LONGEST) // STRIDE) + 1)
    which = np.repeat(np.arange(len(a)), n)
    start = a[which] + STRIDE * (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
    row, sentence, stop = row[which], sentence[which], np.minimum(b[which], start + LONGEST)
    h = roll.words(kept, start, stop)
    h, place, number = np.unique(h, return_index=True, return_inverse=True)
    size = stop[place] - start[place]
    edge = np.concatenate([[0], np.cumsum(size)])
    text = kept[np.arange(edge[-1]) + np.repeat(start[place] - edge[:-1], size)]
    return row, sentence, number, (text, edge, h)


def subsequences(text: np.ndarray, edge: np.ndarray):
    """(string, subsequence, weight) of all occurrences, in parts."""
    n = len(edge) - 1
    marked = np.insert(text, edge[:-1], START) if n else text
    stop = edge[1:] + np.arange(1, n + 1)
    of = np.repeat(np.arange(n), np.diff(edge) + 1)
    last = stop[of]
    wide = marked.astype(np.uint32)
    for steps in STEPS:
        i = np.flatnonzero(np.arange(len(wide)) + steps[-1] < last)
        code = wide[i]
        for s in steps:
            code = (code << np.uint32(8)) | wide[i + s]
        yield of[i], code, DECAY ** (steps[-1] - ORDER + 1)


def own_kernel(text: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Every string's kernel with itself, before normalising (0: no subsequence)."""
    of, code, weight = zip(*[(o, c, np.full(len(o), w)) for o, c, w in subsequences(text, edge)])
    of, code, weight = np.concatenate(of), np.concatenate(code), np.concatenate(weight)
    key = of.astype(np.uint64) << np.uint64(32) | code
    by = np.argsort(key, kind="stable")
    key, weight = key[by], weight[by]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    sums = np.add.reduceat(weight, new) if len(new) else np.zeros(0)
    return np.bincount((key[new] >> np.uint64(32)).astype(np.int64), weights=sums * sums, minlength=len(edge) - 1)


def packed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


class Table:
    """Subsequences of the landmarks, with a bit table ahead of the exact search."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self._slot(codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435769)) >> np.uint32(12)

    def hits(self, of: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings and numbers of the subsequences that a landmark has."""
        if not len(self.codes):
            return of[:0], np.zeros(0, np.int64)
        some = np.flatnonzero(self.bits[self._slot(code)])
        of, code = of[some], code[some]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        ok = self.codes[at] == code
        return of[ok], at[ok]


class Landmarks:
    """The landmarks' subsequences and normalised kernels with them."""

    def __init__(self, parts: list[bytes]):
        text, edge = packed(parts)
        of, code, weight = zip(*[(o, c, np.full(len(o), w)) for o, c, w in subsequences(text, edge)])
        of, code, weight = np.concatenate(of), np.concatenate(code), np.concatenate(weight)
        self.table = Table(np.unique(code))
        self.rows = np.zeros((len(self.table.codes), len(parts)))
        np.add.at(self.rows, (np.searchsorted(self.table.codes, code), of), weight)
        self.rows /= np.sqrt(np.maximum((self.rows ** 2).sum(axis=0), 1e-12))
        value, vector = np.linalg.eigh(self.rows.T @ self.rows)
        good = value > 1e-6
        self.root = vector[:, good] / np.sqrt(value[good])

    def kernels(self, text: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """strings x landmarks: their normalised kernels."""
        out = np.zeros((len(edge) - 1, self.rows.shape[1]))
        for of, code, weight in subsequences(text, edge):
            of, at = self.table.hits(of, code)
            if len(of):
                new = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                out[of[new]] += weight * np.add.reduceat(self.rows[at], new, axis=0)
        norm = np.sqrt(own_kernel(text, edge))
        return out / np.where(norm > 0, norm, 1.0)[:, None]

    def in_parts(self, words: list[bytes], size: int = 10_000):
        """(number of the first word, kernels) of all words, some at a time."""
        for lo in range(0, len(words), size):
            yield lo, self.kernels(*packed(words[lo:lo + size]))

    def features(self, text: np.ndarray, edge: np.ndarray) -> np.ndarray:
        return self.kernels(text, edge) @ self.root


def machine(x: np.ndarray, toxic: np.ndarray, other: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of the least squared hinge loss, rows weighted by their counts."""
    z = np.column_stack([x, np.ones(len(x), dtype=x.dtype)])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    w = np.zeros(z.shape[1])

    def slacks(w):
        f = z @ w.astype(z.dtype)
        return np.maximum(0, 1 - f).astype(float), np.maximum(0, 1 + f).astype(float)

    def loss(w, s):
        return (toxic * s[0] ** 2 + other * s[1] ** 2).sum() + (penalty * w * w).sum()
    s = slacks(w)
    now = loss(w, s)
    for _ in range(steps):
        c = (toxic * (s[0] > 0) + other * (s[1] > 0)).astype(z.dtype)
        gram = np.zeros((z.shape[1], z.shape[1]))
        for lo in range(0, len(z), 16_384):
            part = z[lo:lo + 16_384]
            gram += (part * c[lo:lo + 16_384, None]).T @ part
        step = np.linalg.solve(gram + np.diag(penalty), z.T @ (toxic * s[0] - other * s[1]).astype(z.dtype) - penalty * w)
        size = 1.0
        while (after := loss(w + size * step, t := slacks(w + size * step))) > now and size > 1e-6:
            size /= 2
        if now - after < 1e-9 * now:
            break
        w, now, s = w + size * step, after, t
    return w[:-1], float(w[-1])


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Logistic weights over the columns of x and a constant, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


N_SIGNS = 5


@dataclass
class Model:
    """One weight for each subsequence of a landmark, the bias, and the logistic curve."""
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -1.0
    curve: np.ndarray = field(default_factory=lambda: np.zeros(N_SIGNS + 1))


class Scorer:
    """A model at work in a task; margins of strings met before are kept."""

    def __init__(self, model: Model):
        self.model, self.table, self.roll, self.known = model, Table(model.codes), C.Rolling(12), {}

    def margins(self, text: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Margins of the strings; those that can't be positive count as 0."""
        n = len(edge) - 1
        top, least = np.zeros(n), np.zeros(n)
        for of, code, weight in subsequences(text, edge):
            least += weight * weight * np.bincount(of, minlength=n)
            hit, at = self.table.hits(of, code)
            top += np.bincount(hit, weights=weight * self.model.weight[at], minlength=n)
        # repeated subsequences only raise a string's own kernel, so ``least`` bounds it
        maybe = np.flatnonzero(top + self.model.bias * np.sqrt(least) > 0)
        out = np.zeros(n)
        if len(maybe):
            size = np.diff(edge)[maybe]
            part = np.concatenate([[0], np.cumsum(size)])
            own = own_kernel(text[np.arange(part[-1]) + np.repeat(edge[maybe] - part[:-1], size)], part)
            out[maybe] = np.maximum(0.0, top[maybe] / np.sqrt(np.maximum(own, 1e-12)) + self.model.bias)
        return out

    def signs(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """rows x N_SIGNS: what the score is made of."""
        row, sentence, number, (text, edge, h) = strings(data, offs, self.roll)
        keys = h.tolist()
        margin = np.array([self.known.get(k, -1.0) for k in keys])
        new = np.flatnonzero(margin < 0)
        if len(new):
            size = np.diff(edge)[new]
            part = np.concatenate([[0], np.cumsum(size)])
            margin[new] = self.margins(text[np.arange(part[-1]) + np.repeat(edge[new] - part[:-1], size)], part)
            if len(self.known) > CACHED:
                self.known.clear()
            self.known.update(zip((keys[i] for i in new), margin[new].tolist()))
        n, m = len(offs) - 1, margin[number]
        words, bad = np.bincount(row, minlength=n), np.bincount(row, weights=m > 0, minlength=n)
        first = np.unique(sentence, return_index=True)[1]
        worst = np.unique(sentence[m > 0], return_index=True)[1]
        all_s, bad_s = np.bincount(row[first], minlength=n), np.bincount(row[m > 0][worst], minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, row, m)
        return np.column_stack([np.log1p(bad), np.log1p(1000 * bad / np.maximum(words, 1)), bad_s / np.maximum(all_s, 1), bad > 1, np.minimum(top, 2.0)])

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return sigmoid(np.column_stack([self.signs(data, offs), np.ones(len(offs) - 1)]) @ self.model.curve)


def _lower(batches):
    for b in batches:
        yield b.set_column(b.schema.get_field_index("text"), "text", pc.utf8_lower(b.column("text")))


def ratio(toxic: np.ndarray, other: np.ndarray, all_toxic: float, all_other: float) -> np.ndarray:
    """Log-likelihood ratio of counts against the totals; negative for those commoner
    outside of toxic texts."""
    n, share = toxic + other, all_toxic / (all_toxic + all_other)
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / e), 0.0)
    g = 2 * (part(toxic, n * share) + part(other, n * (1 - share)))
    return np.where(toxic > n * share, g, -g)


def landmarks(words: list[bytes], toxic: np.ndarray, other: np.ndarray) -> list[bytes]:
    """Beginnings of words that toxic texts prefer, none of which is the beginning of
    another, and common words of the rest."""
    low, high = LANDMARK_BYTES
    a, b = Counter(), Counter()
    for w, x, y in zip(words, toxic.tolist(), other.tolist()):
        for k in range(low, min(len(w), high) + 1):
            if k == len(w) or w[k] & 0xC0 != 0x80:  # whole characters
                a[w[:k]] += x
                b[w[:k]] += y
    names = [w for w in a if a[w] > 2]
    g = ratio(np.array([a[w] for w in names], float), np.array([b[w] for w in names], float), float(toxic.sum()), float(other.sum()))
    out: list[bytes] = []
    for i in sorted(np.flatnonzero(g >= LEAST_RATIO).tolist(), key=lambda i: (-round(g[i], 6), -len(names[i]), names[i])):
        if len(out) < TOXIC_LANDMARKS and not any(w.startswith(names[i]) or names[i].startswith(w) for w in out):
            out.append(names[i])
    if not out:
        return []
    clean = np.flatnonzero((other > toxic) & (np.array([len(w) for w in words]) >= low))
    clean = clean[np.lexsort((clean, -other[clean]))]
    rest = {words[i]: None for i in clean[:OTHER_LANDMARKS]}
    best: list[list[tuple[float, bytes]]] = [[] for _ in out]
    for lo, alike in Landmarks(out).in_parts([words[i] for i in clean]):
        alike = alike * np.sqrt(other[clean[lo:lo + len(alike)]])[:, None]
        for k, mark in enumerate(out):
            for i in np.argsort(-alike[:, k], kind="stable")[:20 * ALIKE].tolist():
                if alike[i, k] > 0 and not words[clean[lo + i]].startswith(mark):
                    best[k].append((-float(alike[i, k]), words[clean[lo + i]]))
            best[k] = sorted(best[k])[:ALIKE]
    rest.update((w, None) for found in best for _, w in found)
    return out + list(rest)


def lesson(marks: Landmarks, words: list[bytes], toxic: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and counts of the words that have a kernel of ``NEAR`` or more with a
    landmark, and of every n-th other word, in place of n of them, so that about
    ``FAR_WORDS`` of these remain."""
    every = max(1, len(words) // FAR_WORDS)
    x, t, o = [], [], []
    for lo, k in marks.in_parts(words):
        near = k.max(axis=1) >= NEAR
        keep = near | (np.arange(lo, lo + len(k)) % every == 0)
        factor = np.where(near[keep], 1.0, every)
        x.append((k[keep] @ marks.root).astype(np.float32))
        t.append(toxic[lo:lo + len(k)][keep] * factor)
        o.append(other[lo:lo + len(k)][keep] * factor)
    return np.concatenate(x), np.concatenate(t), np.concatenate(o)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled ids outside the held-out fold."""
    labelled = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
                .where((C.crc_mod("doc_id", FOLDS) != HELD) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
                .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    picked = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows × 12 bytes
    texts = C.store(C.id_text(docs).join(F.broadcast(picked), "doc_id").select("toxic", "text"), "labelled")

    def count(batches):
        roll = C.Rolling(12)
        for rows, data, offs in C.text_slices(_lower(batches)):
            row, _, number, (text, edge, _) = strings(data, offs, roll)
            label = rows.column("toxic").to_numpy()
            key, n = np.unique(row * len(edge) + number, return_counts=True)
            n, bad, number = np.minimum(n, PER_TEXT), label[key // len(edge)] > 0, key % len(edge)
            yield pa.RecordBatch.from_arrays([pa.array([text[x:y].tobytes() for x, y in zip(edge, edge[1:])], pa.binary()),
                                              *[pa.array(np.bincount(number[s], weights=n[s], minlength=len(edge) - 1).astype(np.int64)) for s in (bad, ~bad)]],
                                             ["word", "toxic", "other"])
    rows = texts.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in rows}
    share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    model = Model()
    model.curve[-1] = np.log(share / (1 - share))
    if not n.get(1) or not n.get(0):
        return model
    # the words of max_rows texts
    found = texts.mapInArrow(count, "word binary, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow().sort_by("word")
    words, toxic, other = found.column("word").to_pylist(), *(found.column(c).to_numpy().astype(float) for c in ("toxic", "other"))
    marks = landmarks(words, toxic, other)
    if not marks:
        return model
    nystroem = Landmarks(marks)
    x, toxic, other = lesson(nystroem, words, toxic, other)
    w, model.bias = machine(x, TOXIC_WEIGHT * toxic, other)
    model.codes, model.weight = nystroem.table.codes, nystroem.rows @ (nystroem.root @ w)

    def judge(batches):
        scorer = Scorer(model)
        for rows, data, offs in C.text_slices(_lower(batches)):
            signs = scorer.signs(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column("toxic"), pa.ListArray.from_arrays(np.arange(0, signs.size + 1, N_SIGNS, dtype=np.int32), pa.array(signs.ravel()))],
                                             ["toxic", "signs"])
    seen = texts.mapInArrow(judge, "toxic int, signs array<double>").toArrow()  # max_rows texts × N_SIGNS numbers
    x = np.array(seen.column("signs").to_pylist())
    order = np.lexsort(x.T)
    model.curve = curve(x[order], seen.column("toxic").to_numpy()[order].astype(float))
    return model


def classify(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    def run(batches):
        scorer = Scorer(model)
        for rows, data, offs in C.text_slices(_lower(batches)):
            p = scorer.scores(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])
    return (C.id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
            .select("doc_id", (C.crc_mod("doc_id", FOLDS) == HELD).alias("held_out"), "score", "predicted"))


def op12_toxicity(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    return classify(docs, train(docs, C.table(spark, sf_dir, "labels")))
