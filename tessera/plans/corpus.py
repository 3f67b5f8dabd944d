"""A document table and the derived frames every later stage reads.

Each property is a lazily built DataFrame. The packed documents and the vocabulary, which all
later stages read, are stored in the shared folder when they are first asked for;
other frames used by several later stages can be materialised there."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keywords as K
from ..operators import terms as TR
from ..operators import vectors as V
from ..session import stored


class Corpus:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 stop_words: list[str] | dict[str, list[str]] | None = None, n_docs: int | None = None,
                 stats: DataFrame | None = None, lang_col: str | None = None):
        """``stats``/``n_docs`` from a built corpus make this a corpus of new
        documents scored against the built one's idf (prediction). Stop words may be
        one list or one for each language; then ``lang_col`` is a row's language."""
        self.lang = "lang" if lang_col else None
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                                *([F.col(lang_col).alias("lang")] if lang_col else []))
        self.stop_words = stop_words
        self._n_docs = n_docs
        self._foreign = stats is not None
        if stats is not None:
            self.__dict__["stats"] = stats

    @cached_property
    def prepared(self) -> DataFrame:
        return TR.prepare(self.docs, "doc_id", "text", self.stop_words, self.lang)

    @cached_property
    def packed(self) -> DataFrame:
        """Stored when first asked for: all that follows reads it, and no text is cleaned twice."""
        return TR.packed(self.prepared)

    @cached_property
    def terms(self) -> DataFrame:
        return TR.doc_terms(self.packed)

    @cached_property
    def n_docs(self) -> int:
        return self._n_docs if self._n_docs is not None else TR.corpus_size(self.docs)

    @cached_property
    def stats(self) -> DataFrame:
        return stored(TR.term_stats(self.terms, self.n_docs), "stats")

    @cached_property
    def weighted(self) -> DataFrame:
        return TR.weighted_terms(self.packed, self.stats, self.n_docs if self._foreign else None)

    @cached_property
    def sequences(self) -> DataFrame:
        return TR.doc_sequences(self.packed, self.stats, self.n_docs if self._foreign else None)

    @cached_property
    def candidates(self) -> DataFrame:
        return K.candidate_rows(self.sequences)

    @cached_property
    def scored(self) -> DataFrame:
        return K.candidate_arrays(self.candidates)

    def keywords(self, use_mmr: bool = True, thresholded: bool = True, top_n: int = K.TOP_N,
                 diversity: float = K.DIVERSITY) -> DataFrame:
        arr = K.mmr_array(self.sequences, top_n, diversity) if use_mmr else K.top_n_array(self.sequences, top_n)
        if thresholded:
            arr = K.threshold_array(arr)
        return K.explode_keywords(arr)

    def token_vectors(self, only_tokens: DataFrame | None = None) -> DataFrame:
        return V.token_vectors(self.terms, only_tokens)

    def phrase_vectors(self, phrases: DataFrame, key: str, text_col: str = "phrase",
                       tvecs: DataFrame | None = None) -> DataFrame:
        """Vectors of phrases; token vectors are built for the phrases' tokens only."""
        if tvecs is None:
            toks = phrases.select(F.explode_outer(F.split(F.col(text_col), " ")).alias("token"))
            tvecs = self.token_vectors(toks.where(F.col("token").isNotNull()))
        return V.phrase_vectors(phrases, key, self.stats, tvecs, text_col)

    def doc_vectors(self, tvecs: DataFrame | None = None) -> DataFrame:
        """Vectors of the documents, by the corpus's own token vectors or given ones."""
        rows = stored(self.weighted.select("doc_id", "slice", "token", "wd"), "weighted")
        return V.doc_vectors(rows, V.token_vectors(self.terms) if tvecs is None else tvecs)

    def materialize(self, *names: str) -> "Corpus":
        """Checkpoint the named frames in the shared checkpoint folder (eager):
        later uses read them back instead of recomputing, and a lost executor
        cannot force a recomputation."""
        from ..session import cut_lineage
        for n in names:
            self.__dict__[n] = cut_lineage(getattr(self, n))
        return self
