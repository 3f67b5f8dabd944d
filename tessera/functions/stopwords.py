"""Stop words removed before n-grams are formed, for one language or by language.

The list is MLlib's public default English list
(``StopWordsRemover.loadDefaultStopWords("english")``), written out so that the
SQL oracle can inline the very same words. The raw words contain apostrophes,
so the set actually used is the raw list passed through the same cleaning as
document text (``cleaned_stop_words``)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.ml.feature import StopWordsRemover

# MLlib's names of its public lists, by language code.
LISTS = {"da": "danish", "de": "german", "en": "english", "es": "spanish", "fi": "finnish", "fr": "french", "hu": "hungarian",
         "it": "italian", "nl": "dutch", "no": "norwegian", "pt": "portuguese", "ru": "russian", "sv": "swedish", "tr": "turkish"}

# MLlib default English stop words, in their published order.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll "
    "they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't "
    "wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's "
    "there's what's when's where's who's why's would"
).split()

_WORD = re.compile(r"[^\W\d]+")


def cleaned_stop_words(words=ENGLISH_STOP_WORDS) -> list[str]:
    """Tokens of the stop list after the document cleaning rule (lower case, no
    accents, letter runs, length 2..15, no leading underscore), sorted and distinct."""
    out = set()
    for w in words:
        plain = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", w.lower()) if unicodedata.category(c) != "Mn"))
        for t in _WORD.findall(plain):
            if 2 <= len(t) <= 15 and not t.startswith("_"):
                out.add(t)
    return sorted(out)


def stop_words_by_language(codes=tuple(LISTS)) -> dict[str, list[str]]:
    """{language code: cleaned list}, from MLlib's public lists (needs a session)."""
    return {c: cleaned_stop_words(StopWordsRemover.loadDefaultStopWords(LISTS[c])) for c in codes}
