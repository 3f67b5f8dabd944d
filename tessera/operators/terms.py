"""Corpus preparation and term statistics.

Shapes:
  prepared   doc_id, tokens ARRAY<STRING>, content ARRAY<STRING>  (content = tokens minus stop words)
  packed     doc_id, slice, words, tf, code, firsts, sig          (one row per document, see ``packed``)
  doc_terms  doc_id, sig, token, tf                               (one row per distinct token of a document)
  term_stats token, df, cf, idf                                    (one row per vocabulary token)

``idf(t) = ln((N + 1) / (df(t) + 1)) + 1`` with N the number of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored
from .vectors import signature

SLICE_TOKENS = 1 << 18  # tokens of the documents that one task weighs at a time


def prepare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            stop_words: list[str] | dict[str, list[str]] | None = None, lang_col: str | None = None) -> DataFrame:
    """Row-local cleaning: no shuffle; the scan reads only the named columns. Stop
    words by language (a dict) go by ``lang_col``; without it the language is null."""
    toks = T.clean_tokens(F.col(text_col))
    if not isinstance(stop_words, dict):
        return (docs.select(F.col(id_col).alias("doc_id"), toks.alias("tokens"))
                .withColumn("content", T.drop_stop_words(F.col("tokens"), stop_words)))
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), toks.alias("tokens"), lang.alias("lang"))
    return rows.select("doc_id", "tokens", T.drop_stop_words_by(F.col("lang"), F.col("tokens"), stop_words).alias("content"))


def packed(prepared: DataFrame) -> DataFrame:
    """A stored table with one row a document that has a token: doc_id, slice, words (its distinct
    tokens, sorted), tf (of each word), code (its tokens in text order, as places in words),
    firsts (how often a word stands at its first position; 1 but for documents of one id)
    and sig (the document's signature).

    No text is moved: a document is packed in its own row. Only rows of an id that several
    rows have are brought together; they are one document, whose tokens go by position and
    then by token. A slice is documents of one task that follow each other, of about
    ``SLICE_TOKENS`` tokens."""
    rows = prepared.select("doc_id", "content")
    many = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("of"))
    many = stored(many, "repeated_ids")
    each = rows.select("doc_id", F.array("content").alias("contents"))
    if not many.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("of"))
        each = each.join(many, same, "left_anti").unionByName(
            rows.join(many, same, "left_semi").groupBy("doc_id").agg(F.collect_list("content").alias("contents")))
    key = prepared.schema["doc_id"].dataType.simpleString()
    out = each.mapInArrow(_pack, f"doc_id {key}, slice long, words array<string>, tf array<int>, code array<int>, firsts array<int>")
    return stored(out.withColumn("sig", signature(F.col("doc_id"))), "packed")


def _lists(parts: list[np.ndarray], values: pa.Array | None = None) -> pa.ListArray:
    """One list a part: its numbers, or the values at them."""
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat) if values is None else values.take(pa.array(flat)))


def _pack(batches):
    slice_, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        outer = batch.column("contents")
        inner = outer.values  # offsets count from the start of these
        names = inner.values.dictionary_encode()
        by_name = pc.sort_indices(names.dictionary)
        place = np.empty(len(by_name), dtype=np.int64)
        place[by_name.to_numpy()] = np.arange(len(by_name))
        codes = place[names.indices.to_numpy()]
        texts, tokens = outer.offsets.to_numpy(), inner.offsets.to_numpy()
        docs, slices, words, tfs, code, firsts = [], [], [], [], [], []
        for i, (lo, hi) in enumerate(zip(texts, texts[1:])):
            mine = codes[tokens[lo]:tokens[hi]]
            if not len(mine):
                continue
            if hi - lo > 1:
                pos = np.concatenate([np.arange(n) for n in np.diff(tokens[lo:hi + 1])])
                order = np.lexsort((mine, pos))
                mine, pos = mine[order], pos[order]
            word, at, tf = np.unique(mine, return_inverse=True, return_counts=True)
            first = np.ones(len(word), np.int64)
            if hi - lo > 1:
                least = np.full(len(word), len(mine))
                np.minimum.at(least, at, pos)
                first = np.bincount(at[pos == least[at]], minlength=len(word))
            docs.append(i)
            slices.append(slice_)
            for column, part in ((words, word), (tfs, tf), (code, at), (firsts, first)):
                column.append(part)
            held += len(mine)
            if held >= SLICE_TOKENS:
                slice_, held = slice_ + 1, 0
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(slices, pa.int64()), _lists(words, names.dictionary.take(by_name)),
             _lists(tfs), _lists(code), _lists(firsts)], ["doc_id", "slice", "words", "tf", "code", "firsts"])


def doc_terms(packed: DataFrame) -> DataFrame:
    """(document, token) counts over content tokens: the rows of the packed documents."""
    return (packed.select("doc_id", "sig", "tf", F.posexplode("words").alias("at", "token"))
            .select("doc_id", "sig", "token", F.col("tf")[F.col("at")].cast("long").alias("tf")))


def corpus_size(docs: DataFrame) -> int:
    """N for idf: a single scalar aggregate brought to the driver."""
    return int(docs.count())


def term_stats(terms: DataFrame, n_docs: int) -> DataFrame:
    """Vocabulary with document frequency, collection frequency and idf.
    Partial aggregation makes a token present in most documents cheap."""
    return (terms.groupBy("token")
            .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
            .withColumn("idf", F.log((F.lit(float(n_docs)) + 1.0) / (F.col("df") + 1.0)) + 1.0))


def _in_slices(packed: DataFrame, stats: DataFrame, n_docs: int | None, work, schema: str) -> DataFrame:
    """work(documents, known) for each slice: its packed documents and the (token, idf) of
    their tokens. A token's idf goes to a slice once, not to each of its documents
    there, and a document is moved once, packed.

    With ``n_docs`` given, ``stats`` comes from another corpus (prediction):
    tokens it has never seen have the df = 0 idf."""
    need = packed.select("slice", F.explode("words").alias("token")).distinct()
    known = need.join(stats.select("token", "idf"), "token", "inner" if n_docs is None else "left")
    if n_docs is not None:
        known = known.withColumn("idf", F.coalesce(F.col("idf"), F.log(F.lit(float(n_docs)) + 1.0) + 1.0))
    known = known.select(F.col("slice").alias("of_slice"), "token", "idf")
    return packed.drop("sig").groupBy("slice").cogroup(known.groupBy("of_slice")).applyInArrow(work, schema)


def _one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _weights(docs: pa.Table, known: pa.Table):
    """The documents' words in one array, where each document's begin, and tf, idf and tf·idf of each word."""
    lists = _one(docs["words"])
    words, starts = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    at = pc.index_in(words, value_set=_one(known["token"])).to_numpy()
    idf = known["idf"].to_numpy()[at]
    tf = _one(docs["tf"]).flatten().to_numpy()
    return words, starts, tf, idf, tf * idf


def _weigh(docs: pa.Table, known: pa.Table) -> pa.Table:
    words, starts, tf, idf, wd = _weights(docs, known)
    of = pa.array(np.repeat(np.arange(docs.num_rows), np.diff(starts)))
    return pa.table({"doc_id": docs["doc_id"].take(of), "slice": docs["slice"].take(of), "token": words,
                     "tf": pa.array(tf, pa.int64()), "idf": idf, "wd": wd})


def _sequence(docs: pa.Table, known: pa.Table) -> pa.Table:
    words, starts, _, idf, wd = _weights(docs, known)
    code, firsts = _one(docs["code"]), _one(docs["firsts"]).flatten().to_numpy()
    size = pc.list_value_length(code).to_numpy()
    at = code.flatten().to_numpy() + np.repeat(starts[:-1], size)
    square = wd * wd
    # added one by one in order of token, so that the norm is the same on every run
    norm = [np.cumsum(np.repeat(square[lo:hi], firsts[lo:hi]))[-1] for lo, hi in zip(starts, starts[1:])]
    seq = pa.StructArray.from_arrays([words.take(pa.array(at)), pa.array(idf[at]), pa.array(wd[at])], ["token", "idf", "wd"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    return pa.table({"doc_id": docs["doc_id"], "seq": pa.ListArray.from_arrays(offsets, seq), "dnorm": np.sqrt(np.array(norm, dtype=np.float64))})


def weighted_terms(packed: DataFrame, stats: DataFrame, n_docs: int | None = None) -> DataFrame:
    """doc_terms with the document's slice, and idf and tf-idf weight attached slice by slice."""
    key = packed.schema["doc_id"].dataType.simpleString()
    return _in_slices(packed, stats, n_docs, _weigh, f"doc_id {key}, slice long, token string, tf long, idf double, wd double")


def doc_sequences(packed: DataFrame, stats: DataFrame, n_docs: int | None = None) -> DataFrame:
    """Per document: its content tokens in text order, each carrying idf and
    tf·idf (``seq``), and the document norm ``dnorm``."""
    key = packed.schema["doc_id"].dataType.simpleString()
    return _in_slices(packed, stats, n_docs, _sequence, f"doc_id {key}, seq array<struct<token:string,idf:double,wd:double>>, dnorm double")
