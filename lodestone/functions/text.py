"""Terms of a text: the expression that the index and its queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on exactly these words and suffixes.
STOP_WORDS = ("a", "an", "the", "is", "are", "and", "or", "to", "in", "of", "for", "with", "on", "at", "this", "that", "it", "be", "have", "has")
SUFFIXES = (("ing", 3), ("s", 1), ("ed", 2))

#: A run of a-z and 0-9 with no word character on either side, ASCII rules.
WORD = r"(?<![a-z0-9_])[a-z0-9]+(?![a-z0-9_])"


def _stem(term: Column) -> Column:
    out = None
    for suffix, more_than in SUFFIXES:
        hit = F.endswith(term, F.lit(suffix)) & (F.length(term) > more_than)
        cut = F.substring(term, F.lit(1), F.length(term) - len(suffix))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(term)


def words_of(text: Column) -> Column:
    """Array of the words of a text in its order, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def stemmed(words: Column) -> Column:
    """Their terms: one suffix stripped, stop words and empty terms dropped after that."""
    return F.filter(F.transform(words, _stem), lambda t: ~t.isin(*STOP_WORDS) & (t != ""))


def terms(text: Column) -> Column:
    """Array of terms in text order: lower case, one suffix stripped, stop words and empty terms dropped after that."""
    return stemmed(words_of(text))


def contains_text(text: Column, query: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(text), F.lit(query.lower()))
