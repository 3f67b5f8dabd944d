"""Distributional vectors (V1-V7) and vector helpers.

No embedding model exists here, so the engine derives its own vectors from the
corpus by random indexing (Kanerva et al., 2000):

* each document d has a fixed ±1 signature s(d, j), j < 64, from md5(doc_id);
* a token's vector is T(t)[j] = Σ_d tf(t, d)·s(d, j) — integers, so any
  summation order gives the same result;
* a phrase (keyword, label, document) vector is L2(Σ_t n_t·idf(t)·T(t)).

Sums by token and phrase are 64 unrolled ``sum`` aggregates in one group-by: hash
aggregation with map-side partial sums, whole-stage codegen, no Python. Document
vectors are sums inside slices of documents (``doc_vectors``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as VF

DIM = VF.DIM
SLICE_DOCS = 1024  # documents whose vectors one task sums at a time
SUM_ROWS = 1 << 16  # rows x 64 products that are in memory at once


def signature(key: Column) -> Column:
    """The signature of a document as the 64 bits of a long: the first 16 hex digits of md5(doc_id)."""
    h = F.md5(key.cast("string"))
    half = [F.conv(F.substring(h, at, 8), 16, 10).cast("long") for at in (1, 9)]
    return F.shiftleft(half[0], 32).bitwiseOR(half[1])


def token_vectors(terms: DataFrame, only_tokens: DataFrame | None = None) -> DataFrame:
    """token, tv ARRAY<BIGINT>[64]. ``only_tokens`` (a one-column ``token``
    frame) restricts the work to the tokens actually needed, via a semi-join
    before the aggregation. Terms with a column ``sig`` bring their document's signature."""
    own = "sig" in terms.columns
    t = terms.select("sig" if own else "doc_id", "token", "tf")
    if only_tokens is not None:
        t = t.join(only_tokens.select("token").distinct(), "token", "left_semi")
    if not own:
        t = t.select("token", "tf", signature(F.col("doc_id")).alias("sig"))
    # component j is bit j % 4 of hex digit j // 4
    sums = [F.sum(F.col("tf") * (F.shiftright("sig", 60 - j // 4 * 4 + j % 4).bitwiseAND(1) * 2 - 1)).alias(f"c{j}")
            for j in range(DIM)]
    return t.groupBy("token").agg(*sums).select("token", F.array(*[F.col(f"c{j}") for j in range(DIM)]).alias("tv"))


def _weighted_sum(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """key, v ARRAY<DOUBLE> = L2(Σ weight·tv) over the rows of each key."""
    sums = [F.sum(F.col(weight) * F.col("tv")[j]).alias(f"c{j}") for j in range(DIM)]
    agg = rows.groupBy(key).agg(*sums)
    raw = F.array(*[F.col(f"c{j}").cast("double") for j in range(DIM)])
    return agg.select(key, VF.l2_normalize(raw).alias("v"))


def phrase_vectors(phrases: DataFrame, key: str, stats: DataFrame, tvecs: DataFrame,
                   text_col: str = "phrase") -> DataFrame:
    """V3/V4: vectors of short space-separated phrases (keywords, labels).
    Tokens outside the vocabulary contribute nothing."""
    toks = (phrases.select(key, F.explode_outer(F.split(F.col(text_col), " ")).alias("token"))
            .where(F.col("token").isNotNull() & (F.col("token") != ""))
            .groupBy(key, "token").agg(F.count(F.lit(1)).alias("n")))
    rows = (toks.join(stats.select("token", "idf"), "token").join(tvecs, "token")
            .withColumn("w", F.col("n") * F.col("idf")))
    return _weighted_sum(rows, key, "w")


def _slice_sums(rows: pa.Table, vectors: pa.Table) -> pa.Table:
    """(doc_id, v) of a slice's (doc_id, token, wd) rows and its tokens' vectors. Sums go
    in order of token, so a result is the same on every run."""
    vectors = vectors.sort_by("known")
    rows = rows.append_column("at", pc.index_in(rows["token"], value_set=vectors["known"].combine_chunks()))
    rows = rows.filter(pc.is_valid(rows["at"]))
    ids = rows["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    doc, at = ids.indices.to_numpy(zero_copy_only=False), rows["at"].to_numpy()
    order = np.lexsort((at, doc))
    doc, at, weight = doc[order], at[order], rows["wd"].to_numpy()[order]
    tv = vectors["tv"].combine_chunks().flatten().to_numpy().reshape(-1, DIM)
    out = np.zeros((len(ids.dictionary), DIM))
    for a in range(0, len(doc), SUM_ROWS):
        part = doc[a:a + SUM_ROWS]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out[part[first]] += np.add.reduceat(weight[a:a + SUM_ROWS, None] * tv[at[a:a + SUM_ROWS]], first, axis=0)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    v = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, DIM, dtype=np.int32)), pa.array(v.ravel()))
    return pa.table({"doc_id": ids.dictionary, "v": lists})


def doc_vectors(weighted: DataFrame, tvecs: DataFrame, n_docs: int = 0) -> DataFrame:
    """V2: document vectors from (doc_id, token, wd = tf·idf) rows; a document without a
    known token has none.

    Documents lie in slices: those of the rows' column ``slice``, or, of about ``n_docs``
    documents, 1,024 each. A token's vector goes to a slice once, not to
    each of its documents there, and a document is whole in its slice, so no 64-wide
    row of a (document, token) pair or of a partial sum is moved. A token of a third of
    all rows is one row a slice. Slices are more with more documents, not larger.
    Both uses of ``weighted`` read it, so it should be a stored table."""
    slices = max(1, -(-int(n_docs) // SLICE_DOCS))
    own = F.col("slice") if "slice" in weighted.columns else F.pmod(F.xxhash64("doc_id"), F.lit(slices))
    rows = weighted.select(own.alias("slice"), "doc_id", "token", F.col("wd").cast("double").alias("wd"))
    need = rows.select("slice", "token").distinct().join(tvecs.select("token", F.col("tv").cast("array<double>").alias("tv")), "token")
    key = weighted.schema["doc_id"].dataType.simpleString()
    return (rows.groupBy("slice").cogroup(need.select(F.col("slice").alias("of_slice"), F.col("token").alias("known"), "tv").groupBy("of_slice"))
            .applyInArrow(_slice_sums, f"doc_id {key}, v array<double>"))


def vector_text(v: Column, scale: int = 1_000_000) -> Column:
    """Exact text form for comparison: coordinates × scale, rounded, joined."""
    return F.concat_ws(",", F.transform(v, lambda x: F.round(x * scale).cast("bigint").cast("string")))
