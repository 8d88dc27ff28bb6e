"""Text helpers: blank test, lexicon sentiment, name-based news id, truncation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentiment lexicon.
POSITIVE_TERMS = (
    "gain", "rise", "up", "surge", "bull", "positive", "growth",
    "strong", "beat", "exceed", "optimistic", "rally", "booming", "record high",
)
NEGATIVE_TERMS = (
    "fall", "drop", "down", "decline", "bear", "negative", "loss",
    "weak", "miss", "plunge", "pessimistic", "slump", "crisis", "recession",
)

# Anything outside the control white space and the Unicode separators makes a text non-blank.
NON_BLANK = r"[^\t-\r\x1c-\x1f\p{Z}]"


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text (all white space, not spaces alone)."""
    return text.isNull() | ~text.rlike(NON_BLANK)


def distinct_term_hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur in the text as substrings; a repeated term counts once."""
    hits = (F.contains(text, F.lit(term)).cast("int") for term in terms)
    return reduce(lambda a, b: a + b, hits, F.lit(0))


def sentiment(
    headline: Column,
    summary: Column,
    positive: Sequence[str] = POSITIVE_TERMS,
    negative: Sequence[str] = NEGATIVE_TERMS,
) -> Column:
    """POSITIVE or NEGATIVE when one lexicon leads the other by two terms or more, else NEUTRAL."""
    text = F.lower(F.concat_ws(" ", headline, summary))
    lead = distinct_term_hits(text, positive) - distinct_term_hits(text, negative)
    return F.when(lead >= 2, "POSITIVE").when(lead <= -2, "NEGATIVE").otherwise("NEUTRAL")


def name_uuid(name: Column) -> Column:
    """Version 3 (MD5) UUID of the text's UTF-8 bytes, without a namespace."""
    digest = F.md5(name.cast("binary"))
    # The two high bits of the variant digit become binary 10, whatever the digest held.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("3"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def news_id(headline: Column, url: Column) -> Column:
    """The same headline and url always give the same id, so re-delivery overwrites."""
    return name_uuid(F.concat(headline, url))


def truncate(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def same_text(a: Column, b: Column | str) -> Column:
    """Case-insensitive equality; null never matches."""
    other = F.lit(b) if isinstance(b, str) else b
    return F.coalesce(F.lower(a) == F.lower(other), F.lit(False))


def contains_text(text: Column, term: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(text), F.lower(F.lit(term)))
