"""Column expressions for text cleaning (P1-P8). All are built-in Spark
expressions, so they run inside whole-stage codegen on the executors; no Python
runs per row.

Cleaning rule (same order as the reference's preprocessing):
  1. remove every ``<...>`` tag, inserting nothing;
  2. lower-case;
  3. remove accents (canonical decomposition, drop non-spacing marks, recompose);
  4. tokens = maximal runs of word characters that are not decimal digits;
  5. keep tokens of 2..15 characters that do not start with ``_``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import cleaned_stop_words

# The tag pattern and the token class.
TAG_PATTERN = r"<([^>]+)>"
# Python's ``\w`` minus ``\d``: letters, letter/other numbers, underscore.
TOKEN_PATTERN = r"[\p{L}\p{Nl}\p{No}_]+"
MIN_TOKEN_LEN = 2
MAX_TOKEN_LEN = 15


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """``translate`` arguments that remove accents, built by rule from the
    Unicode database: every code point whose decomposition-minus-marks differs
    from itself maps to that single character; every non-spacing mark is
    deleted (listed after the mapped characters, with no replacement)."""
    src, dst, drop = [], [], []
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        if unicodedata.category(c) == "Mn":
            drop.append(c)
            continue
        nfd = unicodedata.normalize("NFD", c)
        base = unicodedata.normalize("NFC", "".join(x for x in nfd if unicodedata.category(x) != "Mn"))
        if base != c:
            if len(base) == 1:
                src.append(c)
                dst.append(base)
            elif len(base) == 0:
                drop.append(c)
    return "".join(src) + "".join(drop), "".join(dst)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG_PATTERN, "")


def deaccent(c: Column) -> Column:
    match, replace = _accent_table()
    return F.translate(c, match, replace)


def normalized_text(c: Column) -> Column:
    """Steps 1-3: tags removed, lower case, accents removed. Null → ''."""
    return deaccent(F.lower(strip_tags(F.coalesce(c, F.lit("")))))


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(normalized_text(c), F.lit(TOKEN_PATTERN), 0)


def clean_tokens(c: Column) -> Column:
    """ARRAY<STRING> of cleaned tokens in text order (steps 1-5)."""
    return F.filter(
        raw_tokens(c),
        lambda t: (F.length(t) >= MIN_TOKEN_LEN) & (F.length(t) <= MAX_TOKEN_LEN) & ~t.startswith("_"),
    )


def clean_text(tokens: Column) -> Column:
    return F.concat_ws(" ", tokens)


def drop_stop_words(tokens: Column, stop_words: list[str] | None = None) -> Column:
    """Remove stop words keeping order and repeats (``array_except`` would
    de-duplicate). The literal list becomes a hash-set membership test."""
    stop = cleaned_stop_words() if stop_words is None else list(stop_words)
    if not stop:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*stop))


def drop_stop_words_by(lang: Column, tokens: Column, lists: dict[str, list[str]]) -> Column:
    """``drop_stop_words`` with the list of the row's own language: one hash set for
    each language, row by row, no join. A null language, or one without a list, has the
    list under the empty code, or else the default list."""
    out = None
    for code in sorted(c for c in lists if c):
        kept = drop_stop_words(tokens, lists[code])
        out = F.when(lang == code, kept) if out is None else out.when(lang == code, kept)
    rest = drop_stop_words(tokens, lists.get(""))
    return rest if out is None else out.otherwise(rest)


def ngrams(tokens: Column, n_max: int = 3) -> Column:
    """All 1..n_max-grams of ``tokens`` in order (repeats kept), as
    space-joined strings. Row-local: no shuffle."""
    def gram(n: int):
        return lambda t, i: F.when(i + n <= F.size(tokens), F.concat_ws(" ", F.slice(tokens, i + 1, n)))

    parts = [F.transform(tokens, gram(n)) for n in range(1, n_max + 1)]
    return F.filter(F.flatten(F.array(*parts)), lambda g: g.isNotNull())
