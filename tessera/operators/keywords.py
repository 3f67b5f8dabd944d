"""Keyword ranking.

A candidate is a distinct 1..3-gram of a document's content tokens (stop words
were removed first, so n-grams bridge them). Relevance of candidate c to its
document d is the cosine of their tf-idf bags:

    rel(c, d) = Σ_t n_t(c)·idf(t) · tf(t, d)·idf(t) / (‖c‖ ‖d‖)

and two candidates are compared by the cosine of their bags. Maximal marginal
relevance picks the most relevant candidate first, then repeatedly the one
maximising ``(1-λ)·rel - λ·max(sim to picked)``; ties go to the alphabetically
first candidate. Picks are reported by relevance rounded to 4 places (ties keep
pick order), and a document keeps the keywords scoring strictly above a third of
its best score.

Arrays are exploded with the ``*_outer`` generators plus a null filter: a
plain explode lets the optimizer infer ``size(array) > 0`` and push it below
the projection that builds the array, re-evaluating it per element.

``candidate_rows`` scores candidates as rows with built-in expressions. Keywords are
picked from the token sequences themselves (``picked``): a document's candidates, a
few times its length, live in numpy arrays of its task alone and are neither rows nor
list cells, so nothing of them is sorted, spilled or moved. Sums run in the same
order in both, so the figures are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed values (reference defaults).
NGRAM_MAX = 3
TOP_N = 10
DIVERSITY = 0.4
THRESHOLD_DIVISOR = 3.0

def _pairsum(a: str, b: str, w: str = "idf") -> str:
    """Σ_j Σ_k [a_j = b_k]·a_j.w·b_k.w over two ≤3-entry sorted multisets, in a
    fixed order (absent entries add an exact 0)."""
    terms = [f"IF(get({a}, {j}).token = get({b}, {k}).token, get({a}, {j}).{w} * get({b}, {k}).{w}, 0D)"
             for j in range(3) for k in range(3)]
    return "(" + " + ".join(terms) + ")"


def _dot(m: str) -> str:
    return "(" + " + ".join(f"coalesce(get({m}, {j}).idf * get({m}, {j}).wd, 0D)" for j in range(3)) + ")"


def candidate_rows(sequences: DataFrame, n_max: int = NGRAM_MAX) -> DataFrame:
    """K1 as rows: doc_id, keyword, m, cnorm, rel — one row per distinct
    candidate of a document.

    ``m`` is the candidate's token multiset sorted by token, each entry
    carrying idf and the document weight tf·idf; with at most 3 entries every
    measure is a fixed scalar expression inside whole-stage codegen. Distinct
    grams are found inside the row and exploded; the later per-document
    collect groups on doc_id, which the input is already hash partitioned by,
    so it adds no shuffle."""
    n = int(n_max)
    parts = []
    for k in range(1, n + 1):
        words = ", ".join(f"seq[i + {j}].token" for j in range(k))
        parts.append(
            f"IF(size(seq) >= {k}, transform(sequence(0, size(seq) - {k}), i -> named_struct("
            f"'keyword', concat_ws(' ', {words}), 'i', i, 'n', {k})), array())")
    # Distinct candidates inside the row: ``sort_array`` (codegen'd natural
    # order) on small (keyword, start, length) structs, keep the first of equal
    # keywords, and only then slice out each candidate's token multiset.
    g0 = sequences.selectExpr("doc_id", "dnorm", "seq", f"sort_array(flatten(array({', '.join(parts)}))) AS g0")
    g1 = g0.selectExpr(
        "doc_id", "dnorm",
        "transform(filter(g0, (x, j) -> j = 0 OR x.keyword != g0[j - 1].keyword), "
        "x -> named_struct('keyword', x.keyword, 'm', sort_array(slice(seq, x.i + 1, x.n)))) AS g")
    rows = (g1.select("doc_id", "dnorm", F.explode_outer("g").alias("x")).where(F.col("x").isNotNull())
            .select("doc_id", "dnorm", F.col("x.keyword").alias("keyword"), F.col("x.m").alias("m")))
    rows = rows.selectExpr("doc_id", "keyword", "m", "dnorm", f"sqrt({_pairsum('m', 'm')}) AS cnorm")
    return rows.selectExpr("doc_id", "keyword", "m", "cnorm",
                           f"IF(dnorm > 0D, {_dot('m')} / (cnorm * dnorm), 0D) AS rel")


def candidate_arrays(rows: DataFrame) -> DataFrame:
    """doc_id, cands ARRAY<STRUCT<keyword, m, cnorm, rel>> sorted by keyword."""
    return rows.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("keyword", "m", "cnorm", "rel"))).alias("cands"))


def relevance_long(rows: DataFrame, digits: int = 6) -> DataFrame:
    """K1 in long form: doc_id, keyword, score (rounded), from ``candidate_rows``."""
    return rows.select("doc_id", "keyword", F.round("rel", digits).alias("score"))


PAD = 1 << 21  # stands for no token; a document's distinct tokens are numbered below it


def _candidates(code: np.ndarray, n_max: int) -> np.ndarray:
    """Distinct 1..n_max-grams of a document's tokens, one row of three tokens each (absent
    ones are -1), in alphabetical order: a space sorts before every token character."""
    parts = []
    for k in range(1, n_max + 1):
        m = len(code) - k + 1
        if m > 0:
            rows = np.full((m, 3), -1)
            for j in range(k):
                rows[:, j] = code[j:j + m]
            parts.append(rows)
    rows = np.concatenate(parts)
    if code.max() + 2 >= PAD:
        return np.unique(rows, axis=0)
    key = np.unique((rows[:, 0] + 1 << 42) | (rows[:, 1] + 1 << 21) | rows[:, 2] + 1)
    return np.stack([key >> 42, (key >> 21) & (PAD - 1), key & (PAD - 1)], axis=1) - 1


def _relevance(grams: np.ndarray, idf: np.ndarray, wd: np.ndarray, dnorm: float):
    """Of each candidate: its tokens sorted (absent ones last), their idf, norm and relevance.
    ``idf`` and ``wd`` are those of the document's distinct tokens."""
    tok = np.sort(np.where(grams < 0, np.iinfo(np.int64).max, grams), axis=1)
    none = tok == np.iinfo(np.int64).max
    at = np.where(none, 0, tok)
    tok = np.where(none, -1, tok)
    w, d = np.where(none, 0.0, idf[at]), np.where(none, 0.0, wd[at])
    square = np.zeros(len(tok))
    for j in range(3):
        for k in range(3):
            square = square + np.where(tok[:, j] == tok[:, k], w[:, j] * w[:, k], 0.0)
    norm = np.sqrt(square)
    dot = w[:, 0] * d[:, 0] + w[:, 1] * d[:, 1] + w[:, 2] * d[:, 2]
    return tok, w, norm, dot / (norm * dnorm) if dnorm > 0 else np.zeros(len(tok))


def _mmr_picks(rel, norm, tok, w, top_n: int, lam: float) -> list[int]:
    """MMR over one document's candidates, which are in alphabetical order. Sums run in the
    same (j, k) order as the SQL expressions, so results equal the SQL oracle's."""
    n = min(top_n, len(rel))
    keep = 1.0 - lam
    maxsim = np.zeros(len(rel))
    picked = np.zeros(len(rel), dtype=bool)
    among = np.zeros(int(tok.max()) + 2, dtype=bool)  # of each token, whether the picked one has it; the last is no token
    a, b, c = np.ascontiguousarray(tok.T)
    picks = []
    for r in range(n):
        score = rel.copy() if r == 0 else keep * rel - lam * maxsim
        score[picked] = -np.inf
        p = int(np.argmax(score))
        picks.append(p)
        picked[p] = True
        if r + 1 < n:
            # a candidate without a token of the picked one has a similarity of 0, which is no new maximum
            mine = tok[p][tok[p] >= 0]
            among[mine] = True
            hit = np.flatnonzero(among[a] | among[b] | among[c])
            among[mine] = False
            terms = np.where(tok[hit, :, None] == mine, w[hit, :, None] * w[p, :len(mine)], 0.0).reshape(len(hit), -1)
            maxsim[hit] = np.maximum(maxsim[hit], terms.cumsum(axis=1)[:, -1] / (norm[hit] * norm[p]))
    return picks


def picked(sequences: DataFrame, top_n: int = TOP_N, diversity: float | None = None, n_max: int = NGRAM_MAX) -> DataFrame:
    """doc_id, picks ARRAY<STRUCT<keyword, rel>>: the top_n candidates by relevance (ties by
    keyword), or, with a diversity, by maximal marginal relevance, in order."""
    k, lam, n_max = int(top_n), diversity if diversity is None else float(diversity), int(n_max)

    def run(batches):
        for b in batches:
            seq = b.column("seq")
            offs = seq.offsets.to_numpy()
            parts = seq.values  # offsets count from the start of this
            names = parts.field("token").dictionary_encode()
            by_name = pc.sort_indices(names.dictionary)
            words = names.dictionary.take(by_name)
            place = np.empty(len(words), dtype=np.int64)
            place[by_name.to_numpy()] = np.arange(len(words))
            codes = place[names.indices.to_numpy()]
            idf, wd = (parts.field(c).to_numpy() for c in ("idf", "wd"))
            size, keyword, rels = [], [], []
            for lo, hi, dnorm in zip(offs, offs[1:], b.column("dnorm").to_pylist()):
                mine, first, code = np.unique(codes[lo:hi], return_index=True, return_inverse=True)
                if not len(mine):
                    size.append(0)
                    continue
                grams = _candidates(code, n_max)
                tok, w, norm, rel = _relevance(grams, idf[lo:hi][first], wd[lo:hi][first], dnorm)
                picks = np.argsort(-rel, kind="stable")[:k] if lam is None else _mmr_picks(rel, norm, tok, w, k, lam)
                size.append(len(picks))
                rels.append(rel[picks])
                keyword += [" ".join(words[int(mine[t])].as_py() for t in grams[p] if t >= 0) for p in picks]
            at = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            items = pa.StructArray.from_arrays([pa.array(keyword, pa.string()), pa.array(np.concatenate([np.zeros(0), *rels]))], ["keyword", "rel"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(at, items)], ["doc_id", "picks"])
    key = sequences.schema["doc_id"].dataType.simpleString()
    return sequences.select("doc_id", "seq", "dnorm").mapInArrow(run, f"doc_id {key}, picks array<struct<keyword:string,rel:double>>")


def top_n_array(sequences: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """K2: doc_id, kws ARRAY<STRUCT<keyword, score>> — the top_n by relevance
    (ties by keyword), score rounded to 4 places."""
    return picked(sequences, top_n).selectExpr(
        "doc_id", "transform(picks, k -> named_struct('keyword', k.keyword, 'score', round(k.rel, 4))) AS kws")


def mmr_array(sequences: DataFrame, top_n: int = TOP_N, diversity: float = DIVERSITY) -> DataFrame:
    """K3: doc_id, kws ARRAY<STRUCT<keyword, score>> picked by maximal marginal
    relevance, ordered by rounded relevance descending, ties by pick order; the
    ordering and rounding are built-in expressions."""
    return picked(sequences, top_n, diversity).selectExpr(
        "doc_id",
        "transform(array_sort(transform(picks, (p, o) -> named_struct('nscore', -round(p.rel, 4), 'o', o, 'keyword', p.keyword))), "
        "k -> named_struct('keyword', k.keyword, 'score', -k.nscore)) AS kws")


def threshold_array(kws_df: DataFrame, divisor: float = THRESHOLD_DIVISOR) -> DataFrame:
    """P9 in-row: keep keywords with score > max(score)/divisor (strict)."""
    return kws_df.selectExpr(
        "doc_id",
        f"filter(kws, k -> k.score > array_max(transform(kws, z -> z.score)) / {float(divisor)!r}D) AS kws")


def explode_keywords(kws_df: DataFrame) -> DataFrame:
    """Long form: doc_id, keyword, score, rank (1-based, array order)."""
    return (kws_df.select("doc_id", F.posexplode_outer("kws").alias("pos", "k")).where(F.col("k").isNotNull())
            .select("doc_id", F.col("k.keyword").alias("keyword"), F.col("k.score").alias("score"),
                    (F.col("pos") + 1).cast("int").alias("rank")))


def vocabulary(doc_keywords: DataFrame) -> DataFrame:
    """A1: distinct keywords with their document count."""
    return doc_keywords.groupBy("keyword").agg(F.countDistinct("doc_id").alias("n_documents"))


def keyword_lists(doc_keywords: DataFrame) -> DataFrame:
    """A2: keywords of each document as a list in rank order."""
    return (doc_keywords.groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("_k"))
            .select("doc_id", F.transform("_k", lambda x: x["keyword"]).alias("keywords")))
